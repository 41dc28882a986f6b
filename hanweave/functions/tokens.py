"""Tokens of mixed Chinese text as built-in column expressions, and the same rules for workers and for SQL.

One regular expression, valid in Java, Python and RE2, cuts the text; the token's shape names its rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanweave.functions.utf8 import sound

# Letters, figures and marks that join into one token.
LETTER = "A-Za-zＡ-ＶＹＺａ-ｚ"
FIGURE = "0-9０-９"
MARK = r":/\\.?%=&#!~@-"
TOKEN = rf"[\r\n]+|[ \t]+|(?:[{LETTER}{FIGURE}{MARK}]|ＷＸ)+|(?s:.)"
#: The same for Java, which would take one stack frame for each turn of a group unless it never gives back what it took.
JAVA_TOKEN = rf"[\r\n]++|[ \t]++|(?:[{LETTER}{FIGURE}{MARK}]|ＷＸ)++|(?s:.)"

# Token types, word types, and which word type a token type becomes.
TOKEN_TYPES = {"end": 0, "space": 1, "chinese": 2, "crlf": 3, "period": 4, "number": 5, "english": 6, "punctuation": 7, "symbol": 8, "other": 9}
WORD_TYPES = {"chinese": 0, "english": 1, "number": 2, "symbol": 3, "punctuation": 4, "other": 5}
TYPE_NAMES = {0: "ZH", 1: "EN", 2: "NUM", 3: "SYM", 4: "PU", 5: "OTH"}
WORD_TYPE_OF = {1: 5, 2: 0, 3: 5, 4: 4, 5: 2, 6: 1, 7: 4, 8: 3, 9: 4}

# The rules in the order in which they are tried, each with its pattern and token type.
RULES = (
    ("crlf", r"[\r\n]+", "crlf"),
    ("space", r"[ \t]+", "space"),
    ("number", rf"[{FIGURE}]+(?:\.[{FIGURE}]+)?", "number"),
    ("english", rf"(?:[{LETTER}]|ＷＸ)+", "english"),
    ("punct", rf"[{MARK}]", "punctuation"),
    ("symbol", rf"(?:[{LETTER}{FIGURE}{MARK}]|ＷＸ)+", "symbol"),
    ("period", "。", "period"),
    ("exclaim", "！", "period"),
    ("question", "？", "period"),
    ("comma", "[,，]", "punctuation"),
    ("quote", "[\"'“”]", "punctuation"),
    ("interpunct", "·", "punctuation"),
    ("cjk", "[一-龥]", "chinese"),
)
SENTENCE = r"[^。！？\r\n]*(?:[。！？]|[\r\n]+)|[^。！？\r\n]+"
MAX_SENTENCE_TOKENS = 999
NOT_CJK = "-NOT-CJK-"


def _by_rule(token: Column, value) -> Column:
    """`value(name, kind)` of the first rule that the token meets. Of the tokens that runs make, those that are none before are symbols."""
    out = None
    for name, pattern, kind in RULES:
        if name == "english":
            hit = F.replace(token, F.lit("ＷＸ"), F.lit("A")).rlike(f"^[{LETTER}]+$")
        elif name == "symbol":
            hit = F.length(token) > 1
        else:
            hit = token.rlike(f"^{pattern.removesuffix('+')}" if name in ("crlf", "space") else f"^{pattern}$")
        out = (out.when if out is not None else F.when)(hit, value(name, kind))
    return out


def token_rule(token: Column) -> Column:
    """Name of the rule that made the token."""
    n = F.octet_length(token)
    return _by_rule(token, lambda name, _: F.lit(name)).when(n == 1, "ascii").when(n == 2, "other2").when(n == 4, "other4").otherwise("cjk")


def token_type(token: Column) -> Column:
    """Token type; a three-byte character outside U+4E00 to U+9FA5 is `other`."""
    return _by_rule(token, lambda _, kind: F.lit(TOKEN_TYPES[kind])).otherwise(F.lit(TOKEN_TYPES["other"]))


def word_type_of(token_type_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in WORD_TYPE_OF.items() for x in kv]), token_type_)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """array<string>; null for null, empty for empty text. Broken encodings give no token."""
    return _tokens(sound(text))


def typed_tokens(text: Column) -> Column:
    """array<struct<text, type>>."""
    return F.transform(tokens(text), lambda t: F.struct(t.alias("text"), token_type(t).alias("type")))


def sentences(text: Column) -> Column:
    """array<array<string>>: tokens by sentence. A sentence ends with 。！？ or line ends, and after 999 tokens."""
    most = MAX_SENTENCE_TOKENS

    def chunks(sentence: Column) -> Column:
        t = _tokens(sentence)
        starts = F.sequence(F.lit(0), F.floor((F.size(t) - 1) / most).cast("int"))
        return F.when(F.size(t) <= most, F.array(t)).otherwise(F.transform(starts, lambda k: F.slice(t, k * most + 1, F.lit(most))))

    return F.flatten(F.transform(F.regexp_extract_all(sound(text), F.lit(SENTENCE), F.lit(0)), chunks))


# The same rules for workers.
_TOKEN = re.compile(TOKEN.replace("(?s:.)", r"[\s\S]"))
_KINDS = [(re.compile(pattern), TOKEN_TYPES[kind]) for _, pattern, kind in RULES]


class _TypeOf(dict):
    """Token -> type; each shape is matched once, single characters and short words are kept."""

    def __missing__(self, token: str) -> int:
        kind = next((k for pattern, k in _KINDS if pattern.fullmatch(token)), TOKEN_TYPES["other"])
        if len(token) == 1 or len(token) < 12 and len(self) < 100_000:
            self[token] = kind
        return kind


type_of = _TypeOf()
split_tokens = _TOKEN.findall


def split_sentences(text: str):
    """Lists of (tokens, types), as `sentences`."""
    texts = split_tokens(text)
    kinds = list(map(type_of.__getitem__, texts))
    start = 0
    for stop in [k for k, kind in enumerate(kinds, 1) if kind == 3 or kind == 4] + [len(texts)]:
        while start < stop:
            end = min(stop, start + MAX_SENTENCE_TOKENS)
            yield texts[start:end], kinds[start:end]
            start = end


# The same rules for SQL.
def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {_sql(TOKEN)})"


def rule_sql(token: str) -> str:
    cases = " ".join(f"WHEN regexp_full_match({token}, {_sql(p)}) THEN '{name}'" for name, p, _ in RULES)
    return f"CASE {cases} WHEN strlen({token}) = 1 THEN 'ascii' WHEN strlen({token}) = 2 THEN 'other2' WHEN strlen({token}) = 4 THEN 'other4' ELSE 'cjk' END"


def type_sql(token: str) -> str:
    cases = " ".join(f"WHEN regexp_full_match({token}, {_sql(p)}) THEN {TOKEN_TYPES[kind]}" for _, p, kind in RULES)
    return f"CASE {cases} ELSE {TOKEN_TYPES['other']} END"


def word_type_sql(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {a} THEN {b}" for a, b in WORD_TYPE_OF.items()) + " END"


def sentences_sql(text: str) -> str:
    most = MAX_SENTENCE_TOKENS
    t = tokens_sql("s")
    return f"flatten(list_transform(regexp_extract_all({text}, {_sql(SENTENCE)}), lambda s: list_transform(range(0, (len({t}) + {most - 1}) // {most}), lambda k: {t}[k * {most} + 1 : (k + 1) * {most}])))"
