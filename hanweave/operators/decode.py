"""Sequence decoders that run inside workers: lattice segmentation, CRF and HMM.

Models are plain tables turned into dictionaries; their size is the model's, not the corpus's.
Ties are always settled: the lower cost, then the longer word, then the earlier tag or
predecessor.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from dataclasses import dataclass, field

import numpy as np

from hanweave.functions.tokens import WORD_TYPES

# Cost of an unknown token, beam width, term ids of unknown words, the cost that never overrides, first user id.
OOV_COST, BEAM, ID_UNKNOWN, ID_UNSEARCHED, DEFAULT_COST, USER_ID_START = 20.0, 3, -1, -2, 16.0, 0x40000000
# What the tags of the segmenting CRF are called, and marks of out-of-vocabulary properties.
SEGMENT_TAGS = ("S", "B", "B1", "B2", "M", "E")
BEGINS_WORD, FILTERED = 1, 2
CHINESE_TOKEN = 2
#: Cost of a tag trigram that the model lacks.
UNSEEN_TRANSITION = 1e6
# Tags of words without an emission, by word type, and of unknown Chinese words, last tried first.
TYPE_TAGS = {4: "PU", 3: "PU", 5: "PU", 2: "CD", 1: "NN"}
OOV_TAGS = ("NR", "VA", "VV", "NN")
_UNKNOWN = [(tag, 0.0) for tag in OOV_TAGS]


class _Both:
    """Two dictionaries or sets, the first one first."""

    def __init__(self, first, second):
        self.first, self.second = first, second

    def get(self, key):
        found = self.first.get(key)
        return self.second.get(key) if found is None else found

    def __contains__(self, key):
        return key in self.first or key in self.second


class Dictionary:
    """Words with ids and costs, user words merged in, and all their prefixes, so that a walk stops where no word goes on."""

    def __init__(self, words: dict[str, tuple[int, float]], user: dict[str, float] | None = None, bigrams: dict[int, float] | None = None):
        merged = dict(words)
        for rank, (word, cost) in enumerate(sorted((user or {}).items(), key=lambda x: x[0].encode())):
            known = words.get(word)
            if known is None:
                merged[word] = (USER_ID_START + rank, cost)
            elif cost != DEFAULT_COST:
                merged[word] = (known[0], cost)
        self.words = merged
        self.unigrams = {i: cost for i, cost in words.values()}  # the system's costs, as bigrams are relative to them
        self.bigrams = bigrams or {}
        self.prefixes = {w[:k] for w in merged for k in range(1, len(w))}

    def with_words(self, user: dict[str, float]) -> Dictionary:
        """This dictionary with user words besides, which are looked up first; nothing of this one is copied."""
        out = Dictionary.__new__(Dictionary)
        own = Dictionary({w: self.words[w] for w in user if w in self.words}, user)
        out.words, out.prefixes = _Both(own.words, self.words), _Both(own.prefixes, self.prefixes)
        out.unigrams, out.bigrams = self.unigrams, self.bigrams
        return out

    def beams(self, tokens: list[str], bigram: bool, disabled: str | None = None) -> list[list[tuple]]:
        """The cheapest nodes of each place, the best first: (cost of the path, begin, term id, node before)."""
        n, words, prefixes, width = len(tokens), self.words, self.prefixes, BEAM if bigram else 1
        bigrams, unigrams = (self.bigrams, self.unigrams) if bigram else ({}, {})
        # Equal costs put the longer word first.
        ends: list[list] = [[] for _ in range(n + 1)]
        ends[0].append((0.0, 0, 0, None))
        for at in range(n):
            beam = ends[at]
            if not beam:
                continue
            del beam[width:]
            text = ""
            for end in range(at + 1, n + 1):
                text += tokens[end - 1]
                known = words.get(text) if text != disabled else None
                if known is not None:
                    term, cost = known
                    best = None
                    for node in beam:
                        pair = bigrams.get(node[2] << 32 | term) if bigrams else None
                        total = node[0] + (cost if pair is None else pair - unigrams[node[2]])
                        if best is None or total < best[0]:
                            best = (total, node)
                    insort(ends[end], (best[0], at, term, best[1]))  # no two words of a place have one begin
                elif end == at + 1 and not ends[end]:
                    ends[end].append((beam[0][0] + OOV_COST, at, 0, beam[0]))
                if text not in prefixes:
                    break
        del ends[n][width:]
        return ends

    def segment(self, tokens: list[str], bigram: bool, disabled: str | None = None) -> tuple[list[tuple[int, int, int]], float]:
        """(begin, end, term id) of each word over the tokens, and the cost of the path."""
        if not bigram:
            return self._cheapest(tokens, disabled)
        node, out, at = self.beams(tokens, bigram, disabled)[-1][0], [], len(tokens)
        cost = node[0]
        while node[3] is not None:
            out.append((node[1], at, node[2] or ID_UNKNOWN))
            at, node = node[1], node[3]
        out.reverse()
        return out, cost

    def _cheapest(self, tokens: list[str], disabled: str | None) -> tuple[list[tuple[int, int, int]], float]:
        """As `beams` of one node, as arrays: by unigrams a place's best node is all that counts."""
        n, words, prefixes = len(tokens), self.words, self.prefixes
        costs, begins, terms = [0.0] + [None] * n, [0] * (n + 1), [0] * (n + 1)
        for at, text in enumerate(tokens):
            reached, end = costs[at], at + 1
            while True:
                known = words.get(text) if text != disabled else None
                if known is not None:
                    cost = reached + known[1]
                    if costs[end] is None or cost < costs[end]:
                        costs[end], begins[end], terms[end] = cost, at, known[0]
                elif end == at + 1 and costs[end] is None:
                    costs[end], begins[end] = reached + OOV_COST, at
                if end == n or text not in prefixes:
                    break
                text += tokens[end]
                end += 1
        out, at = [], n
        while at:
            begin = begins[at]
            out.append((begin, at, terms[at] or ID_UNKNOWN))
            at = begin
        out.reverse()
        return out, costs[n]


class Crf:
    """Linear-chain CRF: templates over columns of features, weights by feature string.

    `unigram`: feature -> weight per tag; `bigram`: feature -> weight per (left tag, tag), row by row.
    """

    _REFERENCE = re.compile(r"%x\[(-?\d+),(\d+)\]")

    def __init__(self, tags: list[str], templates: list[str], unigram: dict[str, list[float]], bigram: dict[str, list[float]]):
        self.tags, self.unigram, self.bigram = tags, unigram, bigram
        parse = [self._REFERENCE.split(t) for t in templates]
        # Literal, row, column, literal, ...
        pairs = list(zip(templates, ([x if k % 3 == 0 else int(x) for k, x in enumerate(p)] for p in parse)))
        self.unigram_templates = [p for t, p in pairs if t[0] == "U"]
        self.bigram_templates = [p for t, p in pairs if t[0] == "B"]
        self.fixed = all(len(p) == 1 for p in self.bigram_templates)
        self._transitions: dict = {}
        self.offsets = sorted({t[k] for t in self.unigram_templates for k in range(1, len(t), 3)} | {0})
        self._contexts = _Contexts(self)

    def __getstate__(self):
        return (self.tags, self.unigram, self.bigram, self.unigram_templates, self.bigram_templates, self.fixed, self.offsets)

    def __setstate__(self, state):
        self.tags, self.unigram, self.bigram, self.unigram_templates, self.bigram_templates, self.fixed, self.offsets = state
        self._transitions, self._contexts = {}, _Contexts(self)

    @staticmethod
    def feature(template: list, rows: list[tuple[str, ...]], at: int) -> str:
        out = template[0]
        for k in range(1, len(template), 3):
            place = at + template[k]
            if place < 0:
                out += f"_B{place}"
            elif place >= len(rows):
                out += f"_B+{place - len(rows) + 1}"
            else:
                out += rows[place][template[k + 1]]
            out += template[k + 2]
        return out

    def scores(self, rows: list[tuple[str, ...]], at: int) -> list[float]:
        out = [0.0] * len(self.tags)
        for template in self.unigram_templates:
            weights = self.unigram.get(self.feature(template, rows, at))
            if weights:
                out = [x + w for x, w in zip(out, weights)]
        return out

    def transitions(self, rows: list[tuple[str, ...]], at: int) -> list[list[float]]:
        """For each tag the weights from each left tag."""
        names = tuple(self.feature(t, rows, at) for t in self.bigram_templates)
        if names not in self._transitions:
            n = len(self.tags)
            total = [[0.0] * n for _ in range(n)]
            for name in names:
                if weights := self.bigram.get(name):
                    for left in range(n):
                        for tag in range(n):
                            total[tag][left] += weights[left * n + tag]
            if len(self._transitions) > 10_000:
                self._transitions.clear()
            self._transitions[names] = total
        return self._transitions[names]

    def reached(self, cost: list[float], rows: list[tuple[str, ...]], at: int) -> tuple[list[float], list[int]]:
        """Best score of reaching each tag at a place from the scores of the place before, and from which tag."""
        best, lefts = [], []
        for weights in self.transitions(rows, at):
            totals = [c + w for c, w in zip(cost, weights)]
            top = max(totals)
            best.append(top)
            lefts.append(totals.index(top))
        return best, lefts

    def begin(self, rows: list[tuple[str, ...]], begin: int = 0, begin_tag: int = -1, parity: bool = False) -> list[float]:
        """Scores of the tags at the first place, after a begin tag if there is one."""
        if begin_tag >= 0 and not (parity and begin):
            start = [w[begin_tag] for w in self.transitions(rows, begin)]
        else:
            start = [0.0] * len(self.tags)
        return [a + b for a, b in zip(start, self.scores(rows, begin))]

    def tag(self, rows: list[tuple[str, ...]], begin: int = 0, end: int | None = None, begin_tag: int = -1, end_tag: int = -1, parity: bool = False) -> list[int]:
        """Best tags of rows[begin:end]; features see the rows around. With `parity` a begin tag counts only where begin is 0."""
        end = len(rows) if end is None else end
        cost, back = self.begin(rows, begin, begin_tag, parity), []
        for at in range(begin + 1, end):
            best, lefts = self.reached(cost, rows, at)
            back.append(lefts)
            cost = [a + b for a, b in zip(best, self.scores(rows, at))]
        if end_tag >= 0:
            tag = self.reached(cost, rows, end)[1][end_tag]
        else:
            tag = cost.index(max(cost))
        out = [tag]
        for lefts in reversed(back):
            tag = lefts[tag]
            out.append(tag)
        out.reverse()
        return out

    def score_matrix(self, rows: list[tuple[str, ...]], begin: int, end: int) -> list:
        """Keys of the score vectors of rows[begin:end]: what the templates see around each place."""
        width = len(rows[0])
        low, high = max(0, -self.offsets[0]), max(0, self.offsets[-1])
        padded = [(f"_B-{k}",) * width for k in range(low, 0, -1)] + rows + [(f"_B+{k}",) * width for k in range(1, high + 1)]
        shifted = [padded[low + o + begin : low + o + end] for o in self.offsets]
        return list(map(self._contexts.__getitem__, zip(*shifted)))

    def tag_many(self, jobs: list[tuple[list, int, int]], begin_tag: int = -1, end_tag: int = -1, parity: bool = False) -> list[list[int]]:
        """`tag` of many (rows, begin, end) at once: one step of all sequences after the other."""
        if not self.fixed:
            return [self.tag(rows, begin, end, begin_tag, end_tag, parity) for rows, begin, end in jobs]
        if not jobs:
            return []
        self._contexts.trim()
        keys = [self.score_matrix(*job) for job in jobs]
        vectors = self._contexts.vectors()
        lengths = np.array([len(k) for k in keys])
        order = np.argsort(-lengths, kind="stable")
        flat = np.fromiter((x for j in order for x in keys[j]), dtype=np.int64, count=int(lengths.sum()))
        lengths = lengths[order]
        first = np.cumsum(lengths) - lengths
        moves = np.array(self.transitions([], 0))  # by tag, then by left tag
        cost = np.zeros((len(jobs), len(self.tags)))
        if begin_tag >= 0:
            free = np.array([bool(parity and jobs[j][1]) for j in order])
            cost[~free] = moves[:, begin_tag]
        cost = cost + vectors[flat[first]]
        back = []
        alive = len(jobs)
        for at in range(1, int(lengths[0])):
            alive = int(np.searchsorted(-lengths, -at, side="left"))  # those longer than `at`
            totals = cost[:alive, None, :] + moves[None, :, :]
            left = totals.argmax(axis=2)
            back.append(left.astype(np.int8))
            cost[:alive] = np.take_along_axis(totals, left[:, :, None], axis=2)[:, :, 0] + vectors[flat[first[:alive] + at]]
        tag = (cost + moves[end_tag][None, :]).argmax(axis=1) if end_tag >= 0 else cost.argmax(axis=1)
        out = np.zeros(int(lengths.sum()), dtype=np.int64)
        out[first + lengths - 1] = tag
        for at in range(int(lengths[0]) - 1, 0, -1):
            left = back[at - 1]
            n = len(left)
            tag[:n] = left[np.arange(n), tag[:n]]
            out[first[:n] + at - 1] = tag[:n]
        result: list = [None] * len(jobs)
        tags = out.tolist()
        for j, a, n in zip(order.tolist(), first.tolist(), lengths.tolist()):
            result[j] = tags[a : a + n]
        return result

    def probabilities(self, rows: list[tuple[str, ...]], at: int) -> list[float]:
        scores = self.scores(rows, at)
        top = max(scores)
        powers = [math.exp(s - top) for s in scores]
        total = sum(powers)
        return [p / total for p in powers]


class _Contexts(dict):
    """What the unigram templates see -> number of its score vector; kept up to a bound."""

    MOST = 200_000

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf, self.made, self.array = crf, [], None

    def __missing__(self, seen: tuple) -> int:
        offsets, crf, out = self.crf.offsets, self.crf, [0.0] * len(self.crf.tags)
        by_offset = dict(zip(offsets, seen))
        for template in crf.unigram_templates:
            name = template[0]
            for k in range(1, len(template), 3):
                name += by_offset[template[k]][template[k + 1]] + template[k + 2]
            weights = crf.unigram.get(name)
            if weights:
                out = [x + w for x, w in zip(out, weights)]
        self[seen] = len(self.made)
        self.made.append(out)
        return len(self.made) - 1

    def vectors(self) -> np.ndarray:
        if self.array is None or len(self.array) < len(self.made):
            new = np.array(self.made[0 if self.array is None else len(self.array) :])
            self.array = new if self.array is None else np.concatenate([self.array, new])
        return self.array

    def trim(self) -> None:
        if len(self) > self.MOST:
            self.clear()
            self.made, self.array = [], None


def segment_rows(tokens: list[str], types: list[int]) -> list[tuple[str]]:
    return [(t if k == CHINESE_TOKEN else "，",) for t, k in zip(tokens, types)]


def cut_by_crf(crf: Crf, jobs: list[tuple[list, int, int]], parity: bool = False) -> list[list[tuple[int, int]]]:
    """Of each (rows, begin, end) the token ranges of its words: a word ends after S or E."""
    single, last = crf.tags.index("S"), crf.tags.index("E")
    result = []
    for (_, begin, end), tags in zip(jobs, crf.tag_many(jobs, single, single, parity)):
        out, start = [], begin
        for at, tag in enumerate(tags, begin + 1):
            if tag == single or tag == last:
                out.append((start, at))
                start = at
        if start < end:
            out.append((start, end))
        result.append(out)
    return result


def suspicious(words: list[tuple[int, int, int]], tokens: list[str], types: list[int], properties: dict[str, int]) -> list[bool]:
    """Words that may belong to an unknown word: single Chinese characters that are not filtered, and what follows one that begins words."""
    out, after_begin = [], False
    for begin, end, _ in words:
        if end - begin > 1:
            flag, after_begin = after_begin, False
        elif types[begin] != CHINESE_TOKEN:
            flag = after_begin = False
        else:
            kind = properties.get(tokens[begin])
            flag, after_begin = kind != FILTERED, kind == BEGINS_WORD
        out.append(flag)
    return out


def suspicious_runs(words, tokens, types, properties) -> list[tuple[int, int]]:
    """Ranges of words, two or more each, that are to be cut anew."""
    flags, out, k = suspicious(words, tokens, types, properties), [], 0
    while k < len(words):
        stop = k
        while stop < len(words) and flags[stop]:
            stop += 1
        if stop - k > 1:
            out.append((k, stop))
        k = max(stop, k + 1)
    return out


def pos_row(word: str, kind: int) -> tuple[str, str, str]:
    if kind == WORD_TYPES["chinese"]:
        return word, word[:1], word[-1:]
    mark = {1: "A", 3: "A", 2: "1"}.get(kind, ".")
    return mark, mark, mark


@dataclass
class Hmm:
    """Trigram tagger. `emits`: term id -> (tag, cost) in the order in which they are tried."""

    tag_cost: dict[str, float]
    trans: dict[tuple[str, str, str], float]
    emits: dict[int, list[tuple[str, float]]]
    crf: Crf | None = None
    _defaults: dict[int, list] = field(default_factory=dict)
    _unknown: dict[tuple, list] = field(default_factory=dict)

    def __post_init__(self):
        missing = {"BOS", "PU", "CD", "NN", "VV", "VA", "AD", "NR"} - set(self.tag_cost)
        if missing:
            raise ValueError(f"the tag set lacks {sorted(missing)}")
        self._defaults = {kind: [(tag, 0.0)] for kind, tag in TYPE_TAGS.items()}

    def emissions(self, rows: list, at: int, term: int, kind: int) -> list[tuple[str, float]]:
        found = self.emits.get(term) or self._defaults.get(kind)
        if found:
            return found
        if self.crf:
            key = rows[at] if self.crf.offsets == [0] else None
            if key in self._unknown:
                return self._unknown[key]
            p = self.crf.probabilities(rows, at)
            top = max(p)
            found = [(tag, -math.log(x) - self.tag_cost[tag]) for tag, x in zip(self.crf.tags, p) if x > 0.2 * top and tag in self.tag_cost]
            found.reverse()
            if key is not None and len(self._unknown) < 200_000:
                self._unknown[key] = found or list(_UNKNOWN)
        return found or list(_UNKNOWN)

    def tag(self, words: list[tuple[str, int, int]]) -> list[str]:
        """Tags of (word, word type, term id); costs are cut to whole numbers at each step."""
        rows = [pos_row(w, kind) for w, kind, _ in words] if self.crf else []
        beam = [(0, "BOS", (0, "BOS", None))]
        for at, (_, kind, term) in enumerate(words):
            new = []
            for tag, emit in self.emissions(rows, at, term, kind):
                best = None
                for node in beam:
                    cost = node[0] + self.trans.get((node[2][1], node[1], tag), UNSEEN_TRANSITION) + emit
                    if best is None or cost < best[0]:
                        best = (cost, node)
                new.append((int(best[0]), tag, best[1]))
            new.sort(key=lambda x: x[0])
            beam = new[:BEAM]
        node, out = beam[0], []
        for _ in words:
            out.append(node[1])
            node = node[2]
        out.reverse()
        return out
