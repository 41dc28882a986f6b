"""The looks of texts by a rule of its own: no table of the operator is used."""

import unicodedata

# Drawn alike, letter by letter.
_ALIKE = str.maketrans(
    "АВЕКМНОРСТХЅІЈҮӀԌԚԜасеорхуѕіјһӏԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿνοϳ" + "ՕՍհոօս" + "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏙᏚᏞᏟᏢᏦᏴ" + "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ" + "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
    "ABEKMHOPCTXSIJYIGQWaceopxysijhldqw" + "ABEZHIKMNOPTYXJvoj" + "OUhnou" + "DRTAJEWMHGZRVSLCPKB" + "ABEHIKMNOPCTYXopc" + "BPDTGKJCZFMNLSRVHWXYAEIOU",
)
_WHOLE = [(0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x132, 0x133), (0xB5, 0xB5), (0x149, 0x149), (0x2011, 0x2011), (0x3038, 0x303A), (0x2E80, 0x2FDF), (0xF900, 0xFB06), (0xFF00, 0xFFEF), (0x2F800, 0x2FA1F)]
_NOTHING = [(0x34F, 0x34F), (0x180B, 0x180F), (0xFE00, 0xFE0F)]


def _one(ch):
    kind, cp = unicodedata.category(ch), ord(ch)
    if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return " "
    if kind in ("Cf", "Cc") or any(a <= cp <= b for a, b in _NOTHING):
        return ""
    if any(a <= cp <= b for a, b in _WHOLE):
        return unicodedata.normalize("NFKC", ch)
    return ch


def look(text):
    """Joined forms apart, letters of other scripts as Latin ones, accents joined again."""
    apart = unicodedata.normalize("NFD", "".join(map(_one, text)))
    return unicodedata.normalize("NFC", apart.translate(_ALIKE))
