"""License scans by patience alignment.

A text and a license template are aligned on the words that are unique in both: the longest increasing subsequence of these
anchors is kept, and the gaps between them, in which other words are now unique, are aligned the same way.  Coverage is the
share of the template's words that found their place.  So that a license is found wherever and however often it stands, words
that are unique in the template say where their copy starts; where many agree, a copy is aligned in its own range, which ends where the
template's order starts anew.  What this leaves, such as copies with much in between, is aligned in windows of twice the template's length
from each of its words, and only in those that have enough of them.
A notice of a few words counts only with the words that decide which license it names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._batches import append_columns, text_buffers
from ._words import PUNCTUATION, find_words, hash_words
from .license_texts import COMMON, DECIDING, NEGATIONS, TEMPLATES

COVERED = 0.8

#: Words of a template from which votes tell copies apart; a notice of fewer is aligned from each of its words.
VOTING = 24

#: Words before a notice, and two more of its first ones, in which a word like "not" makes it none.
NEGATED = 3

FOUND = T.StructType(
    [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence; of several, the one with the least ends."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[k] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = v, k
    out = []
    k = top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """(place in text, place in template) of the aligned words, in order.

    In a gap equal words at either end are matched first; where no word is unique on both sides, those that stand equally often on
    both are anchors, the first with the first; without any, the gap stays open.
    """
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        places: dict[int, list[int]] = {}
        for k in range(a, b):
            places.setdefault(text[k], []).append(k)
        wanted: dict[int, list[int]] = {}
        for k in range(c, d):
            wanted.setdefault(template[k], []).append(k)
        anchors = [(places[w][0], ks[0]) for w, ks in wanted.items() if len(ks) == 1 and len(places.get(w, ())) == 1]
        if not anchors:
            anchors = sorted(((x, k) for w, ks in wanted.items() if len(ks) == len(places.get(w, ())) for x, k in zip(places[w], ks)), key=lambda p: p[1])
        kept = [anchors[k] for k in longest_increasing([x for x, _ in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(out)


def _best(found: list[tuple[str, float, int, int]], sizes: list[int], names: list[str]) -> list[tuple[str, float, int, int]]:
    """Of occurrences that share half of the shorter one's range, those with the most aligned words less those that are missing."""
    size = dict(zip(names, sizes, strict=True))
    order = sorted(found, key=lambda f: (size[f[0]] * (1 - 2 * f[1]), f[2], f[3], f[0]))
    kept: list[tuple[str, float, int, int]] = []
    for f in order:
        if all(2 * (min(f[3], g[3]) - max(f[2], g[2])) <= min(f[3] - f[2], g[3] - g[2]) for g in kept):
            kept.append(f)
    return kept


def next_kept(kept: list[tuple[int, int]], place: int) -> tuple[int, int]:
    """The first of sorted, disjoint ranges that ends behind `place`; one beyond all texts if none does."""
    k = bisect_right(kept, place, key=lambda r: r[1])
    return kept[k] if k < len(kept) else (1 << 62, 1 << 62)


def _hashed(body: str) -> np.ndarray:
    """The hashed words of one text."""
    data, offsets = text_buffers(pa.array([body], pa.large_string()))
    return hash_words(data, *find_words(data, offsets, PUNCTUATION)[:2])


class Scanner:
    """Templates as hashed words."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.templates = [_hashed(body) for body in templates.values()]
        rules = [DECIDING.get(name, ("", "")) if TEMPLATES.get(name) == body else ("", "") for name, body in templates.items()]
        self.needed = [set(np.flatnonzero(np.isin(t, _hashed(must))).tolist()) for t, (must, _) in zip(self.templates, rules)]
        self.others = [_hashed(other) for _, other in rules]
        self.negations = _hashed(NEGATIONS)
        self.vocabulary = np.unique(np.concatenate(self.templates)) if templates else np.zeros(0, np.uint64)
        self.marked = np.zeros(1 << 16, bool)
        self.marked[self.vocabulary >> np.uint64(48)] = True
        self.own = [np.isin(self.vocabulary, t) for t in self.templates]
        # Where a template is covered, so are most of its words that are not common ones: these say where to look.
        common = _hashed(COMMON)
        self.telling = [own & ~np.isin(self.vocabulary, common) for own in self.own]
        self.need = [int(np.ceil(COVERED * len(t))) for t in self.templates]
        # Before a bare name there may stand the words of a notice.
        self.negated = [2 * NEGATED + 1 if name.endswith("-title") else NEGATED for name in self.names]
        # The words that a template has once, and their places in it.
        self.once = [(words[counts == 1], first[counts == 1]) for words, first, counts in (np.unique(t, return_index=True, return_counts=True) for t in self.templates)]
        self.need_telling = [n - int(np.isin(t, common).sum()) for n, t in zip(self.need, self.templates)]

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        """(license, coverage, start byte, end byte) of each text."""
        data, offsets = text_buffers(texts)
        starts, ends, bounds = find_words(data, offsets, PUNCTUATION)
        words = hash_words(data, starts, ends)
        hit = np.flatnonzero(self.marked[words >> np.uint64(48)]) if len(self.vocabulary) else np.zeros(0, np.int64)
        code = np.searchsorted(self.vocabulary, words[hit])
        right = code < len(self.vocabulary)
        right[right] = self.vocabulary[code[right]] == words[hit[right]]
        hit, code = hit[right], code[right]
        out: list[list[tuple[str, float, int, int]]] = [[] for _ in range(len(texts))]
        for which, template in enumerate(self.templates):
            size = len(template)
            rare = self.need_telling[which] > 0
            need = self.need_telling[which] if rare else self.need[which]
            at = hit[(self.telling if rare else self.own)[which][code]]
            if not size or len(at) < need:
                continue
            # Places from which a window of twice the template's length has enough of its words.
            spread = at[need - 1 :] - at[: len(at) - need + 1] + 1
            first = at[: len(spread)][spread <= 2 * size]
            if not len(first):
                continue
            every = hit[self.own[which][code]]
            for doc in np.unique(np.searchsorted(bounds, first, side="right") - 1).tolist():
                lo, hi = int(bounds[doc]), int(bounds[doc + 1])
                own = every[np.searchsorted(every, lo) : np.searchsorted(every, hi)]
                out[doc] += self._occurrences(words, template, which, own, lo, hi, self.need[which], data, starts, ends, int(offsets[doc]))
        out = [_best(x, [len(t) for t in self.templates], self.names) for x in out]
        return [sorted(x, key=lambda f: (f[2], f[3], f[0])) for x in out]

    def _ranges(self, words: np.ndarray, which: int, at: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
        """Where copies of a template seem to stand among the words from lo to hi, of which those at `at` are its own.

        A word that the template has once votes for the place where the template's first word would be.  Insertions and omissions move
        votes by some places, another copy by the template's length; so votes that lie near each other are one copy, whose range is
        from where its first words say that it starts to where its last ones say that it ends.
        """
        size, (once, places) = len(self.templates[which]), self.once[which]
        if not len(once) or size < VOTING:
            return []
        found = np.minimum(np.searchsorted(once, words[at]), len(once) - 1)
        own = once[found] == words[at]
        where, place = at[own], places[found[own]]
        order = np.argsort(where - place, kind="stable")
        where, place = where[order], place[order]
        votes, near = where - place, 2 * max(2, size // 8)
        ends = np.searchsorted(votes, votes + near, side="right")
        agree = ends - np.arange(len(votes))
        taken: list[int] = []
        out = []
        for k in np.argsort(-agree, kind="stable").tolist():
            if 3 * agree[k] < len(once) or agree[k] < 2:
                break
            beside = bisect_left(taken, int(votes[k]))
            if any(abs(x - votes[k]) < size // 2 for x in taken[max(0, beside - 1) : beside + 1]):
                continue
            taken.insert(beside, int(votes[k]))
            mine = np.arange(k, ends[k])[np.argsort(place[k : ends[k]], kind="stable")]
            start, stop = int(np.median(votes[mine[:3]])), int(np.median(votes[mine[-3:]])) + size
            room = 2 + size // 50
            out.append((max(lo, start - room), min(hi, stop + room)))
        return out

    def _occurrences(self, words, template, which, at, lo, hi, need, data, starts, ends, base) -> list[tuple[str, float, int, int]]:
        size, wanted = len(template), template.tolist()
        places, own = at.tolist(), words[at].tolist()
        walls = [*(np.flatnonzero(np.isin(words[lo:hi], self.others[which])) + lo).tolist(), hi]

        def number(k: int) -> bool:
            return bool(np.all((data[starts[k] : ends[k]] >= 48) & (data[starts[k] : ends[k]] <= 57)))

        def names_it(first: int, pairs: list[tuple[int, int]]) -> bool:
            """Whether the deciding words are aligned, and no other number stands where one of them is to be."""
            must = self.needed[which]
            if not must <= {c for _, c in pairs}:
                return False
            begin = first + pairs[0][0]
            if must and np.isin(words[max(lo, begin - self.negated[which]) : begin + NEGATED + 2], self.negations).any():
                return False
            return not any(y > x + 1 and c in must and number(first + y) and number(first + x + 1) for (x, _), (y, c) in zip(pairs, pairs[1:]))

        # Exact copies are best by any measure and need no alignment.
        kept: list[tuple[int, int]] = []
        for a, w in zip(places, own):
            whole = w == wanted[0] and a + size <= hi and (not kept or a >= kept[-1][1]) and words[a : a + size].tolist() == wanted
            if whole and names_it(a, [(k, k) for k in range(size)]):
                kept.append((a, a + size))
        counts = {k: size for k in kept}
        # Then copies that keep the template's pace, each aligned once in its own range, and again in the room that better ones leave.
        paced = []
        for first, stop in self._ranges(words, which, at, lo, hi):
            wall = walls[bisect_left(walls, first)]
            for a, b in ((first, min(stop, wall)), (wall + 1, stop)):
                pairs = align(words[a:b].tolist(), wanted) if b - a >= need else []
                if len(pairs) >= need and names_it(a, pairs):
                    paced.append((-len(pairs), pairs[-1][0] - pairs[0][0] + 1, a + pairs[0][0], a, b))
        for n, span, a, first, stop in sorted(paced):
            before = bisect_right(kept, a, key=lambda r: r[0])
            first = max(first, kept[before - 1][1]) if before else first
            after = next_kept(kept, a)
            if first > a or after[0] < a + span:
                stop = min(stop, after[0]) if after[0] > a else a
                pairs = align(words[first:stop].tolist(), wanted) if stop - first >= need else []
                if len(pairs) < need or not names_it(first, pairs):
                    continue
                n, span, a = -len(pairs), pairs[-1][0] - pairs[0][0] + 1, first + pairs[0][0]
            insort(kept, (a, a + span))
            counts[a, a + span] = -n
        # Every other one starts at an anchor; the best goes first, and what it overlaps is aligned again in the room that is left.
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(first: int, stop: int) -> None:
            # Over a smaller part as well, since a window may hold parts of two copies, whose words are not unique in it.
            each = (align(words[first:end].tolist(), wanted) for end in {stop, min(stop, first + size + size // 4)})
            best = min(((-len(x), x[-1][0] - x[0][0] + 1, first + x[0][0]) for x in each if len(x) >= need and names_it(first, x)), default=None)
            if best:
                heappush(heap, (*best, first, stop))

        limit, inside, have, right = Counter(wanted), Counter(), 0, 0
        deciding = {wanted[k] for k in self.needed[which]}
        for k, first in enumerate(places):
            after = next_kept(kept, first)
            stop = min(first + 2 * size, walls[bisect_left(walls, first)], after[0]) if after[0] > first else first + 1
            while right < len(places) and places[right] < stop:
                inside[own[right]] += 1
                have += inside[own[right]] <= limit[own[right]]
                right += 1
            if after[0] > first and have >= need and all(inside[w] > 0 for w in deciding):
                offer(first, stop)
            inside[own[k]] -= 1
            have -= inside[own[k]] < limit[own[k]]
        while heap:
            n, span, a, first, stop = heappop(heap)
            after = next_kept(kept, first)
            if after[0] <= first:
                continue
            if after[0] < a + span:
                offer(first, after[0])
                continue
            insort(kept, (a, a + span))
            counts[a, a + span] = -n
        return [(self.names[which], counts[a, b] / size, int(starts[a]) - base, int(ends[b - 1]) - base) for a, b in kept]


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, text: str = "text", out: str = "licenses") -> DataFrame:
    """`df` with the licenses that stand in each whole text in column `out`: an array of (license, coverage, start, end).

    coverage is the share of the template's words (letters and digits, A-Z as a-z) that are aligned, 0.8 or more; start and end
    are code points of the first aligned word's start and the last one's end.  Of occurrences that share more than half of the shorter one's
    range the best is kept: the one with the most aligned words less those missing.  Of the given templates, notices and headers need
    their deciding words (DECIDING): a notice of another license or version is none of them, nor one that a word like "not"
    precedes.  A null or empty text has none.  Rows keep their number and other columns; an input column named `out`
    is replaced; an empty table gives an empty one.
    """
    templates = dict(TEMPLATES if templates is None else templates)

    def make():
        scanner = Scanner(templates)

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = part.column(part.schema.get_field_index(text))
            found = scanner.scan(texts)
            flat = []
            for k, each in enumerate(found):
                if each:
                    raw = texts[k].as_py().encode()
                    flat += [(name, share, len(raw[:a].decode()), len(raw[:b].decode())) for name, share, a, b in each]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array([f[i] for f in flat], kind) for i, kind in enumerate(kinds)]
            return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays(columns, names=FOUND.names))]

        return work

    return append_columns(df, text, [T.StructField(out, T.ArrayType(FOUND))], make)
