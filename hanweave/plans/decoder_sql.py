"""The decoders once more as SQL: lattices, beams and best paths as folds over lists.

Each function gives common table expressions to be put together after `WITH`; `parts` joins them.
"""

from __future__ import annotations

from hanweave.functions import tokens as tk
from hanweave.functions.tokens import NOT_CJK
from hanweave.operators import decode

_SYSTEM = f"(SELECT word, term_id AS t, coalesce(cost, {decode.DEFAULT_COST})::FLOAT::DOUBLE AS c FROM lexicon)"
#: Costs of pairs of neighbours, in the single precision in which they are stored.
_PAIRS = "(SELECT word_left AS l, word_right AS r, (-ln(count(*) / (SELECT count(*) FROM bigram_records WHERE word_left IS NOT NULL AND word_right IS NOT NULL)))::FLOAT::DOUBLE AS c FROM bigram_records WHERE word_left IN (SELECT term_id FROM lexicon) AND word_right IN (SELECT term_id FROM lexicon) GROUP BY ALL)"


def parts(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


def sentences(table: str, key: str, text: str) -> str:
    """`d`: each sentence's tokens by `key`; `s`: each different sentence once, with the types of its tokens."""
    return f"""d AS MATERIALIZED (SELECT {key}, unnest(x) AS toks, generate_subscripts(x, 1) - 1 AS sent_id FROM (SELECT {key}, {tk.sentences_sql(text)} AS x FROM {table})),
    s AS MATERIALIZED (SELECT row_number() OVER () AS sid, toks, list_transform(toks, lambda x: {tk.type_sql('x')}) AS types FROM (SELECT DISTINCT toks FROM d))"""


def lattice(words: str, bigram: bool, p: str = "", where: str = "") -> str:
    """`e`: every dictionary word of each sentence; `x`: of each sentence the list, by place, of the words that end there; `m`: its beams.

    The names end in `p`, as that of the sentences; `where`: which words count, by the sentence's `whole`. A node is its cost, where its word begins, the word's id, and its predecessor's number in the beam there.
    """
    gain = "coalesce(list_filter(w.ds, lambda y: y.l = n.t)[1].d, w.c)" if bigram else "w.c"
    best = f"list_min(list_transform(acc[w.b + 1], lambda n, i: {{'v': n.c + {gain}, 'i': i}}))"
    step = f"list_sort(list_transform(ws, lambda w: list_transform([{best}], lambda r: {{'c': r.v, 'b': w.b, 't': w.t, 'p': r.i}})[1]))[1:{decode.BEAM if bigram else 1}]"
    unknown = f"[{{'c': acc[-1][1].c + {decode.OOV_COST}::DOUBLE, 'b': len(acc) - 1, 't': 0, 'p': 1::BIGINT}}]"
    deltas = f"""q{p} AS (SELECT r.sid, r.b, r.e, list({{'l': l.t, 'd': g.c - u.c}}) AS ds FROM e{p} r JOIN e{p} l ON l.sid = r.sid AND l.e = r.b
      JOIN {_PAIRS} g ON g.l = l.t AND g.r = r.t JOIN {_SYSTEM} u ON u.t = l.t GROUP BY ALL),""" if bigram else ""
    ends = f"e{p} LEFT JOIN q{p} USING (sid, b, e)" if bigram else f"e{p}"
    word = "{'b': b, 't': t, 'c': c, 'ds': ds}" if bigram else "{'b': b, 't': t, 'c': c}"
    return f"""e{p} AS MATERIALIZED (SELECT sid, b, b + n AS e, t, c FROM (SELECT sid, {'whole, ' if where else ''}b, n, array_to_string(toks[b + 1 : b + n], '') AS word
      FROM s{p}, unnest(range(0, len(toks))) AS u(b), unnest(range(1, least(len(toks) - b, (SELECT max(length(word)) FROM {words})) + 1)) AS v(n)) JOIN {words} USING (word) {where}),
    {deltas} x{p} AS MATERIALIZED (SELECT sid, list(coalesce(ws, []) ORDER BY k) AS ws FROM (SELECT sid, k FROM s{p}, unnest(range(1, len(toks) + 1)) AS u(k))
      LEFT JOIN (SELECT sid, e AS k, list({word}) AS ws FROM {ends} GROUP BY ALL) USING (sid, k) GROUP BY sid),
    m{p} AS MATERIALIZED (SELECT sid, list_reduce(ws, lambda acc, ws: list_append(acc, CASE WHEN len(ws) = 0 THEN {unknown} ELSE {step} END),
      [[{{'c': 0::DOUBLE, 'b': 0::BIGINT, 't': 0, 'p': 0::BIGINT}}]]) AS beams FROM x{p})"""


def words_of_lattice(name: str = "w") -> str:
    """The words of the best path: sentence, number, begin, end, term id (-1 unknown)."""
    node = "beams[acc.at + 1][acc.p]"
    step = f"list_transform([{node}], lambda n: {{'at': n.b, 'p': n.p, 'w': list_prepend({{'b': n.b, 'e': acc.at, 't': CASE n.t WHEN 0 THEN {decode.ID_UNKNOWN} ELSE n.t END}}, acc.w)}})[1]"
    empty = "[]::STRUCT(b BIGINT, e BIGINT, t INT)[]"
    return f"""{name} AS MATERIALIZED (SELECT sid, generate_subscripts(w, 1) - 1 AS pos, unnest(w, recursive := true) FROM (SELECT sid, list_reduce(range(1, len(beams)),
      lambda acc, k: CASE WHEN acc.at = 0 THEN acc ELSE {step} END, {{'at': len(beams) - 1, 'p': 1::BIGINT, 'w': {empty}}}).w AS w FROM m))"""


def analyzed(key: str, words: str = "w", tag: str = "'NONE'") -> str:
    """Rows of words with type, id and tag, as `analyze` gives them."""
    return f"""SELECT {key}, sent_id::INT AS sent_id, pos::INT AS pos, array_to_string(toks[b + 1 : e], '') AS word,
      (CASE WHEN e - b > 1 THEN 0 ELSE {tk.word_type_sql('types[b + 1]')} END)::INT AS word_type, t::INT AS term_id, {tag} AS tag
      FROM d JOIN s USING (toks) JOIN {words} w USING (sid)"""


def marked(word: str, kind: str) -> str:
    """The word as vocabularies and neighbours have it."""
    return f"CASE WHEN {kind} = 0 THEN {word} ELSE '{NOT_CJK}' END"


_TAG_OF_PLACE = "CASE WHEN n = 1 THEN 'S' WHEN k = 1 THEN 'B' WHEN k = n THEN 'E' WHEN k = 2 THEN 'B1' WHEN k = 3 THEN 'B2' ELSE 'M' END"
_FOLLOWS = {("B", "B1"), ("B", "E"), ("B1", "B2"), ("B1", "E"), ("B2", "M"), ("B2", "E"), ("M", "M"), ("M", "E")} | {(a, b) for a in "ES" for b in "BS"}
#: For each tag the weights from each left tag of the segmenting CRF.
_MOVES = [[0.0 if (a, b) in _FOLLOWS else -30.0 for a in decode.SEGMENT_TAGS] for b in decode.SEGMENT_TAGS]
_NO_SCORE = "[0::DOUBLE" + ", 0::DOUBLE" * (len(decode.SEGMENT_TAGS) - 1) + "]"


def segment_weights() -> str:
    """`fv`: each feature's weights by tag of the segmenting CRF."""
    columns = ", ".join(f"coalesce(max(weight) FILTER (tag = '{t}'), 0)" for t in decode.SEGMENT_TAGS)
    return f"""fv AS MATERIALIZED (SELECT feature, [{columns}]::DOUBLE[] AS v FROM (SELECT feature, tag, ln(1 + count(*))::FLOAT::DOUBLE AS weight FROM (
      SELECT unnest(CASE WHEN k > 1 THEN ['U01:' || word[k:k], 'U00:' || word[k - 1 : k - 1] || '/' || word[k:k]] ELSE ['U01:' || word[k:k]] END) AS feature, {_TAG_OF_PLACE} AS tag
      FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k, length(word) AS n FROM lexicon)) GROUP BY ALL) GROUP BY feature)"""


def _argmax(values: str) -> str:
    return f"list_transform([{values}], lambda z: {{'v': list_max(z), 'i': list_position(z, list_max(z))}})[1]"


def best_tags(jobs: str, begin_tag: int | None, end_tag: int | None, name: str = "g") -> str:
    """`name`: `jid`, `tags` by number from 1, the best sequence of each job: `f` (its features by place), and its range from `b` up to `e`."""
    row = lambda t: "[" + ", ".join(f"{x}::DOUBLE" for x in _MOVES[t]) + "]"
    moves = "[" + ", ".join(map(row, range(len(_MOVES)))) + "]"
    added = lambda a, b: "[" + ", ".join(f"{a}[{k + 1}] + {b}[{k + 1}]" for k in range(len(_MOVES))) + "]"
    start = "vs[1]" if begin_tag is None else added("[" + ", ".join(f"{r[begin_tag]}::DOUBLE" for r in _MOVES) + "]", "vs[1]")
    best = _argmax("list_transform(acc.c, lambda c, l: c + to_[l])")
    step = f"list_transform([list_transform({moves}, lambda to_: {best})], lambda r: {{'c': list_transform(r, lambda y, t: y.v + v[t]), 'b': list_append(acc.b, list_transform(r, lambda y: y.i))}})[1]"
    last = _argmax("a.c" if end_tag is None else f"list_transform(a.c, lambda c, l: c + ({row(end_tag)})[l])")
    return f"""{name}_v AS MATERIALIZED (SELECT jid, list({added(f'coalesce(p.v, {_NO_SCORE})', f'coalesce(o.v, {_NO_SCORE})')} ORDER BY k) AS vs
      FROM (SELECT jid, k, f[k + 1] AS ch, CASE WHEN k = 0 THEN '_B-1' ELSE f[k] END AS before FROM (SELECT jid, f, unnest(range(b, e)) AS k FROM {jobs}))
      LEFT JOIN fv p ON p.feature = 'U00:' || before || '/' || ch LEFT JOIN fv o ON o.feature = 'U01:' || ch GROUP BY jid),
    {name}_a AS MATERIALIZED (SELECT jid, list_reduce(vs[2:], lambda acc, v: {step}, {{'c': {start}, 'b': []::BIGINT[][]}}) AS a FROM {name}_v),
    {name} AS MATERIALIZED (SELECT jid, list_reduce(list_reverse(a.b), lambda acc, r: list_prepend(r[acc[1]], acc), [{last}.i]) AS tags FROM {name}_a)"""


SENTENCE_FEATURES = f"list_transform(toks, lambda x, i: CASE WHEN types[i] = {decode.CHINESE_TOKEN} THEN x ELSE '，' END)"


def words_of_tags(jobs: str, tags: str = "g", name: str = "c") -> str:
    """`name`: `jid`, `b`, `e` of each word: it ends after S or E, or where the job does."""
    ends = [decode.SEGMENT_TAGS.index(t) + 1 for t in "SE"]
    return f"""{name} AS MATERIALIZED (SELECT jid, min(k) AS b, max(k) + 1 AS e FROM (SELECT jid, k, coalesce(sum((t IN ({ends[0]}, {ends[1]}))::INT)
      OVER (PARTITION BY jid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no
      FROM (SELECT jid, b + generate_subscripts(tags, 1) - 1 AS k, unnest(tags) AS t FROM {tags} JOIN {jobs} USING (jid))) GROUP BY jid, no)"""


def crf_words() -> str:
    """`w`: the words of each sentence by the segmenting CRF alone."""
    jobs = f"j AS MATERIALIZED (SELECT sid AS jid, {SENTENCE_FEATURES} AS f, 0 AS b, len(toks) AS e FROM s)"
    w = f"w AS MATERIALIZED (SELECT jid AS sid, row_number() OVER (PARTITION BY jid ORDER BY b) - 1 AS pos, b, e, {decode.ID_UNSEARCHED} AS t FROM c)"
    return ", ".join([segment_weights(), jobs, best_tags("j", 0, 0), words_of_tags("j"), w])


def suspicious(words: str) -> str:
    """`z`: the words with `flag` (they may belong to an unknown word) and `run`, the number of their run of equal flags."""
    single = f"(e - b = 1 AND types[b + 1] = {decode.CHINESE_TOKEN})"
    flag = f"CASE WHEN e - b > 1 THEN coalesce(lag(begins) OVER o, false) ELSE {single} AND oov_value IS DISTINCT FROM {decode.FILTERED} END"
    return f"""z AS MATERIALIZED (SELECT *, sum(turn::INT) OVER (PARTITION BY sid ORDER BY pos) AS run FROM (SELECT *, flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY sid ORDER BY pos) AS turn
      FROM (SELECT sid, pos, b, e, t, {flag} AS flag FROM (SELECT w.*, types, oov_value, coalesce({single} AND oov_value = {decode.BEGINS_WORD}, false) AS begins
        FROM {words} w JOIN s USING (sid) LEFT JOIN (SELECT word, oov_value FROM lexicon) l ON e - b = 1 AND l.word = toks[b + 1]) WINDOW o AS (PARTITION BY sid ORDER BY pos))))"""


def mixed_words() -> str:
    """`w`: the lattice's words of `w0`, with runs of two or more suspicious ones cut anew by the CRF."""
    jobs = f"""j AS MATERIALIZED (SELECT row_number() OVER () AS jid, sid, {SENTENCE_FEATURES} AS f, r.b, r.e, r.first, r.last
      FROM (SELECT sid, min(b) AS b, max(e) AS e, min(pos) AS first, max(pos) AS last FROM z WHERE flag GROUP BY sid, run HAVING count(*) > 1) r JOIN s USING (sid))"""
    w = f"""w AS MATERIALIZED (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY b) - 1 AS pos, b, e, t FROM (
      SELECT sid, b, e, t FROM w0 WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.sid = w0.sid AND w0.pos BETWEEN j.first AND j.last)
      UNION ALL SELECT j.sid, c.b, c.e, {decode.ID_UNSEARCHED} FROM c JOIN j USING (jid)))"""
    return ", ".join([suspicious("w0"), segment_weights(), jobs, best_tags("j", 0, 0), words_of_tags("j"), w])


def trained(places: str, tags: str) -> str:
    """`tc`, `tr`, `em`: costs of tags, of tag triples and of the dictionary words of each tag, in the single precision in which they are stored.

    `places`, `tags`: the tables of tagged places `p` and counted tags `t`.
    """
    return f"""{tags}, tc AS MATERIALIZED (SELECT tag, (-ln(n / (SELECT sum(n) FROM t)))::FLOAT::DOUBLE AS c FROM t),
    tr AS MATERIALIZED (SELECT tag1, tag2, tag3, (-ln(n / (sum(n) OVER (PARTITION BY tag1, tag2))))::FLOAT::DOUBLE AS c FROM (
      SELECT x.tag AS tag1, y.tag AS tag2, z.tag AS tag3, coalesce(f.n, 0) + 1 AS n FROM t x, t y, t z LEFT JOIN (
        SELECT coalesce(c.tag, 'BOS') AS tag1, coalesce(b.tag, 'BOS') AS tag2, a.tag AS tag3, count(*) AS n FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND b.sent_no = a.sent_no AND b.pos = a.pos - 1
        LEFT JOIN p c ON c.doc_id = a.doc_id AND c.sent_no = a.sent_no AND c.pos = a.pos - 2 GROUP BY ALL) f ON f.tag1 = x.tag AND f.tag2 = y.tag AND f.tag3 = z.tag WHERE z.tag <> 'BOS')),
    em AS MATERIALIZED (SELECT tag, word, (-ln(n / m))::FLOAT::DOUBLE AS c FROM (SELECT tag, word, count(*) AS n FROM p GROUP BY ALL) JOIN (SELECT tag, count(*) AS m FROM p GROUP BY tag) USING (tag) JOIN lexicon USING (word))"""


_SHAPE = "CASE kind WHEN 0 THEN word ELSE CASE kind WHEN 1 THEN 'A' WHEN 3 THEN 'A' WHEN 2 THEN '1' ELSE '.' END END"


def tagging_words() -> str:
    """`v`: the words of `w` with type, and `u`: each different (word, type) with what the tagging CRF sees of it."""
    return f"""v AS MATERIALIZED (SELECT sid, pos, w.b, w.e, t, array_to_string(toks[w.b + 1 : w.e], '') AS word, CASE WHEN w.e - w.b > 1 THEN 0 ELSE {tk.word_type_sql('types[w.b + 1]')} END AS kind FROM w JOIN s USING (sid)),
    u AS MATERIALIZED (SELECT word, kind, {_SHAPE} AS f0, CASE kind WHEN 0 THEN word[1:1] ELSE {_SHAPE} END AS f1, CASE kind WHEN 0 THEN word[-1:] ELSE {_SHAPE} END AS f2 FROM (SELECT DISTINCT word, kind FROM v))"""


def tagging_scores() -> str:
    """`sc`: of each (word, type) of `u` the scores of all tags but BOS, in order; `pw`, `pm`: weights of features, and moves between tags."""
    feature = "SELECT unnest(['U00:' || p.word, 'U01:' || p.word[1:1], 'U02:' || p.word[-1:]]) AS feature, tag FROM p WHERE p.word <> '' AND p.word IN (SELECT word FROM lexicon)"
    known = lambda k: f"LEFT JOIN pw w{k} ON w{k}.feature = 'U0{k}:' || f{k} AND w{k}.tag = n.tag"
    return f"""pw AS MATERIALIZED (SELECT feature, tag, ln(1 + count(*))::FLOAT::DOUBLE AS v FROM ({feature}) GROUP BY ALL),
    pn AS MATERIALIZED (SELECT tag, row_number() OVER (ORDER BY tag) AS i FROM tc WHERE tag <> 'BOS'),
    sc AS MATERIALIZED (SELECT word, kind, list(coalesce(w0.v, 0) + coalesce(w1.v, 0) + coalesce(w2.v, 0) ORDER BY i) AS vs FROM u CROSS JOIN pn n {known(0)} {known(1)} {known(2)} GROUP BY word, kind)"""


def tagged_by_crf() -> str:
    """`tg`: sentence, place and tag of each word by the tagging CRF."""
    best = _argmax("list_transform(acc.c, lambda c, l: c + to_[l])")
    step = f"list_transform([list_transform(moves, lambda to_: {best})], lambda r: {{'c': list_transform(r, lambda y, t: y.v + v[t]), 'b': list_append(acc.b, list_transform(r, lambda y: y.i))}})[1]"
    return f"""pm AS MATERIALIZED (SELECT list(row ORDER BY i) AS moves FROM (SELECT r.i, list(coalesce(v, 0) ORDER BY l.i) AS row FROM pn l CROSS JOIN pn r LEFT JOIN (
      SELECT a.tag AS ltag, b.tag AS rtag, ln(1 + count(*))::FLOAT::DOUBLE AS v FROM p b JOIN p a ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.pos = b.pos - 1 GROUP BY ALL) m ON m.ltag = l.tag AND m.rtag = r.tag GROUP BY r.i)),
    sv AS MATERIALIZED (SELECT sid, list(vs ORDER BY pos) AS vs FROM v JOIN sc USING (word, kind) GROUP BY sid),
    sa AS MATERIALIZED (SELECT sid, list_reduce(vs[2:], lambda acc, v: {step}, {{'c': vs[1], 'b': []::BIGINT[][]}}) AS a FROM sv, pm),
    sb AS MATERIALIZED (SELECT sid, list_reduce(list_reverse(a.b), lambda acc, r: list_prepend(r[acc[1]], acc), [{_argmax('a.c')}.i]) AS tags FROM sa),
    tg AS MATERIALIZED (SELECT sid, k - 1 AS pos, tag FROM (SELECT sid, unnest(tags) AS i, generate_subscripts(tags, 1) AS k FROM sb) JOIN pn USING (i))"""


def tagged_by_hmm(crf: bool) -> str:
    """`tg`: sentence, place and tag of each word by the trigrams; `crf`: unknown words get their tags from the tagging CRF."""
    defaults = ", ".join(f"({k}, '{t}')" for k, t in decode.TYPE_TAGS.items())
    unknown = ", ".join(f"('{t}', {k})" for k, t in enumerate(decode.OOV_TAGS))
    guess = """SELECT word, tag, -ln(x / total) - c AS c, -i AS o FROM (SELECT word, i, exp(v - top) AS x, top, total FROM (SELECT word, top, list_reduce(vs, lambda acc, v: acc + exp(v - top), 0::DOUBLE) AS total, unnest(vs) AS v, generate_subscripts(vs, 1) AS i
        FROM (SELECT word, kind, vs, list_max(vs) AS top FROM sc) WHERE kind = 0)) JOIN pn USING (i) JOIN tc USING (tag) WHERE x / total > 0.2 * (1 / total)""" if crf else f"SELECT word, tag, 0 AS c, o FROM u, (VALUES {unknown}) y(tag, o) WHERE kind = 0"
    # A term is known by its id, or by its word where the CRF cut it.
    emits = f"""SELECT sid, pos, em.tag, em.c, -row_number() OVER (PARTITION BY sid, pos ORDER BY em.tag) AS o FROM v JOIN em USING (word) WHERE t > 0 OR t = {decode.ID_UNSEARCHED}
      UNION ALL SELECT sid, pos, y.tag, 0, 0 FROM v JOIN (VALUES {defaults}) y(kind, tag) USING (kind) WHERE NOT ((t > 0 OR t = {decode.ID_UNSEARCHED}) AND word IN (SELECT word FROM em))
      UNION ALL SELECT sid, pos, y.tag, y.c, y.o FROM v JOIN ({guess}) y USING (word) WHERE kind = 0 AND NOT ((t > 0 OR t = {decode.ID_UNSEARCHED}) AND word IN (SELECT word FROM em))"""
    before = lambda k: f"(SELECT sid, pos + {k} AS pos, tag FROM y UNION ALL SELECT sid, unnest(range(0, {k})), 'BOS' FROM (SELECT DISTINCT sid FROM y)) x{k}"
    total = "n.c + list_filter(w.ts, lambda z: z.a = n.a AND z.b = n.g)[1].c + w.c"
    best = f"list_min(list_transform(acc[-1], lambda n, i: {{'v': {total}, 'i': i, 'g': n.g}}))"
    step = f"list_sort(list_transform(ws, lambda w: list_transform([{best}], lambda r: {{'c': trunc(r.v), 'o': w.o, 'g': w.g, 'a': r.g, 'p': r.i}})[1]))[1:{decode.BEAM}]"
    return f"""y AS MATERIALIZED (SELECT sid, pos, tag, c::DOUBLE AS c, o FROM ({emits})),
    yt AS MATERIALIZED (SELECT sid, pos, y.tag, list({{'a': x2.tag, 'b': x1.tag, 'c': tr.c}}) AS ts FROM y JOIN {before(1)} USING (sid, pos) JOIN {before(2)} USING (sid, pos)
      JOIN tr ON tr.tag1 = x2.tag AND tr.tag2 = x1.tag AND tr.tag3 = y.tag GROUP BY ALL),
    yl AS MATERIALIZED (SELECT sid, list(ws ORDER BY pos) AS ws FROM (SELECT sid, pos, list({{'g': tag, 'c': c, 'o': o, 'ts': ts}} ORDER BY o) AS ws FROM y JOIN yt USING (sid, pos, tag) GROUP BY ALL) GROUP BY sid),
    ym AS MATERIALIZED (SELECT sid, list_reduce(ws, lambda acc, ws: list_append(acc, {step}), [[{{'c': 0::DOUBLE, 'o': 0::BIGINT, 'g': 'BOS', 'a': 'BOS', 'p': 0::BIGINT}}]]) AS beams FROM yl),
    tg AS MATERIALIZED (SELECT sid, generate_subscripts(g, 1) - 1 AS pos, unnest(g) AS tag FROM (SELECT sid, list_reduce(range(1, len(beams)), lambda acc, k:
      list_transform([beams[acc.at][acc.p]], lambda n: {{'at': acc.at - 1, 'p': n.p, 'g': list_prepend(n.g, acc.g)}})[1], {{'at': len(beams), 'p': 1::BIGINT, 'g': []::VARCHAR[]}}).g AS g FROM ym))"""


def tagged(key: str) -> str:
    """Rows of words with type, id and the tag of `tg`."""
    return f"SELECT {key}, sent_id::INT AS sent_id, pos::INT AS pos, word, kind::INT AS word_type, t::INT AS term_id, tag FROM d JOIN s USING (toks) JOIN v USING (sid) JOIN tg USING (sid, pos)"


def segmenter(name: str, words: str = _SYSTEM) -> str:
    """`w`: the words of each sentence by one of the segmenters."""
    if name == "crf":
        return crf_words()
    if name == "mixed":
        return ", ".join([lattice(words, True), words_of_lattice("w0"), mixed_words()])
    return ", ".join([lattice(words, name == "bigram"), words_of_lattice()])


def tagger(name: str, places: str, tags: str) -> str:
    """`tg`: the tags of the words of `w` by one of the taggers."""
    own = {"crf": [tagging_scores(), tagged_by_crf()], "hmm": [tagged_by_hmm(False)], "hmm_crf": [tagging_scores(), tagged_by_hmm(True)]}[name]
    return ", ".join([trained(places, tags), tagging_words(), *own])


def reached(vectors: str) -> str:
    """`jid`, `rs`: of each list of score vectors the best scores of reaching each tag at the places after the first."""
    moves = "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in r) + "]" for r in _MOVES) + "]"
    step = f"list_transform([list_transform({moves}, lambda to_: list_max(list_transform(acc.c, lambda c, l: c + to_[l])))], lambda r: {{'c': list_transform(r, lambda y, t: y + v[t]), 'r': list_append(acc.r, r)}})[1]"
    return f"SELECT jid, list_reduce(vs[2:], lambda acc, v: {step}, {{'c': vs[1], 'r': []::DOUBLE[][]}}).r AS rs FROM {vectors}"
