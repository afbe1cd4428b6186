"""Problem 7: held-out evaluation texts that appear, wholly or partly, in a corpus.

The test items are normalised to words and put into one generalised suffix automaton. Each document's words stream
through it once; the automaton gives the longest match that ends at every word, and a match votes for the items that
contain it if it is as long as their seed. An item's seed is so short that a reported passage must contain one
(see ``seed_length``), so the vote loses nothing. An exact alignment then chains the matches of a document and a voted item
into passages that allow replaced words, and keeps the pair if one or two passages hold enough of the item's words.
Removal cuts the passages out by their places in the source text, so markup, links and entities around them stay.

Scale: documents are read once and never moved, whatever the number of items. Items come to the driver one partition at a
time and leave it in shards of ``SHARD_WORDS`` words, each broadcast as plain text; tasks build one shard's automaton at a
time (its size is linear in the shard's words) and stream a bounded buffer of documents through it before the next.

Defined results: null, empty and wordless documents or items match nothing, nor do items of a single word; an item of up to
four words is found only whole, a longer one needs four words or more; no passage holds fewer than two words, nor fewer than
``least_passage`` says; repeated items each match; repeated document rows repeat their results; an empty table
gives an empty result; any text length is streamed whole; other input columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import ship_package, spread

#: Words of items in one automaton.
SHARD_WORDS = 200_000
#: Characters of documents that a task holds while it goes through several shards.
BUFFER_CHARS = 32 << 20
MIN_SHARE = 0.45
#: One word in so many may have been replaced inside a passage.
REPLACED_ONE_IN = 7
MAX_GAP = 3
#: Words that every report needs (a shorter item: all its words).
MIN_WORDS = 4
#: A passage need not hold more words than this, however long the item.
PASSAGE_WORDS = 5

_TAG = regex.compile(r"</?[A-Za-z!][^<>]*+>|\]\([^()\s]*+\)")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_QUOTES = regex.compile(r"['’‘`´ʼ]")
_BROKEN = regex.compile(r"(\w++)[-‐‑]\s*\n[\s>|*#]*(\w++)")
_WORD = regex.compile(r"[^\W_]++")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str, vocabulary: dict[str, int] | None = None) -> list[str]:
    """Words of a text without case, punctuation, markup, layout, invisible characters and accents.

    A word broken at a line end is joined if the joined form is in ``vocabulary``, else read as two words.
    """
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "<" in text or "](" in text:
        text = _TAG.sub(" ", text)
    if text.isascii():  # the same by faster means
        text = text.lower().replace("'", "").replace("`", "")
    else:
        text = _QUOTES.sub("", text.casefold())
    if vocabulary and "\n" in text:
        text = _BROKEN.sub(lambda m: m[1] + m[2] if m[1] + m[2] in vocabulary else f"{m[1]} {m[2]}", text)
    return _ASCII_WORD.findall(text) if text.isascii() else _WORD.findall(text)


_ENTITY = regex.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


class _Placed:
    """A text under rewriting whose characters remember the range of the source they come from."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, [(i, i + 1) for i in range(len(text))]

    def rewrite(self, pattern: regex.Pattern, by: Callable[[regex.Match], list[tuple[str, int, int]]]) -> None:
        """Replace each match by pieces (text, from, to), whose range of the present text they stand for."""
        out, at, last = [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[last : m.start()])
            at += self.at[last : m.start()]
            for piece, i, j in by(m):
                out.append(piece)
                at += [(self.at[i][0], self.at[j - 1][1])] * len(piece)
            last = m.end()
        self.text, self.at = "".join([*out, self.text[last:]]), at + self.at[last:]

    def each(self, by: Callable[[str], str], groups: regex.Pattern) -> None:
        self.rewrite(groups, lambda m: [(by(m[0]), m.start(), m.end())])


#: A character that normalisation may change with the combining ones behind it, whose order it may change.
_CLUSTER = regex.compile(r"[^\x00-\x7F]\p{M}*+|[\x00-\x7F]\p{M}++")
_ANY = regex.compile(r"(?s).")


def placed_words(text: str, vocabulary: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """``words`` with the range of the source text that each comes from."""
    t = _Placed(text)
    t.each(html.unescape, _ENTITY)
    if not t.text.isascii():
        t.each(lambda c: _MARKS.sub("", unicodedata.normalize("NFKD", c)), _CLUSTER)
    t.rewrite(_TAG, lambda m: [(" ", m.start(), m.end())])
    folded = t.text.casefold()
    if len(folded) == len(t.text):  # no character became several
        t.text = folded
    else:
        t.each(str.casefold, _ANY)
    t.rewrite(_QUOTES, lambda m: [])
    if vocabulary:
        t.rewrite(_BROKEN, lambda m: [(m[1], *m.span(1)), *([] if m[1] + m[2] in vocabulary else [(" ", m.end(1), m.start(2))]), (m[2], *m.span(2))])
    return [(m[0], t.at[m.start()][0], t.at[m.end() - 1][1]) for m in _WORD.finditer(t.text)]


def needed_words(n_words: int, share: float = MIN_SHARE) -> float:
    """Words of an item that a document must repeat."""
    return max(share * n_words - 1e-9, min(n_words, MIN_WORDS))


def least_passage(n_words: int, share: float = MIN_SHARE) -> int:
    """Words that each passage of an item must hold: a quarter of what is needed, between two and ``PASSAGE_WORDS``."""
    return min(PASSAGE_WORDS, max(2, math.ceil(share * n_words / 4)))


def seed_length(n_words: int, share: float = MIN_SHARE) -> int:
    """Words in a row that any reportable repetition of an item must have.

    The larger of two passages has p >= share * n / 2 words, of which at most p / 7 are replaced; they split the rest
    into at most p / 7 + 1 runs, so the longest run has at least (6 p / 7) / (p / 7 + 1) words.
    """
    p = max(1.0, share * n_words / 2)
    kept = p * (REPLACED_ONE_IN - 1) / REPLACED_ONE_IN
    return max(2, math.ceil(kept / (p / REPLACED_ONE_IN + 1) - 1e-9))


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences.

    The sequences that contain a state's strings are those that end in its subtree of suffix links; subtrees are ranges of
    one list, so the whole takes space in proportion to the words. ``least`` gives each sequence's seed.
    """

    def __init__(self, sequences: list[list[int]], least: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: dict[int, list[int]] = defaultdict(list)
        for k, sequence in enumerate(sequences):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
                if not ends[last] or ends[last][-1] != k:
                    ends[last].append(k)
        below: list[list[int]] = [[] for _ in self.length]
        for state in range(1, len(self.length)):
            below[self.link[state]].append(state)
        self.low, self.high, self.order = [0] * len(self.length), [0] * len(self.length), []
        todo = [0]
        while todo:
            state = todo.pop()
            if state < 0:
                self.high[~state] = len(self.order)
                continue
            self.low[state] = len(self.order)
            self.order += ends.get(state, ())
            todo.append(~state)
            todo += below[state]
        self.least = least
        self.shortest = min(least, default=1)
        self._known: dict[tuple[int, int], frozenset[int]] = {}

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence has this string already
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _voted(self, state: int, matched: int) -> frozenset[int]:
        """Sequences that hold a suffix, no shorter than their seed, of the ``matched`` words that lead to ``state``."""
        known, path = self._known, []
        key = (state, matched)
        while key[1] >= self.shortest and key not in known:
            path.append(key)
            up = self.link[key[0]]
            key = (up, self.length[up])
        found = known[key] if key[1] >= self.shortest else frozenset()
        for at in reversed(path):
            seed_over = self.length[self.link[at[0]]]
            new = {k for k in self.order[self.low[at[0]] : self.high[at[0]]] if seed_over < self.least[k] <= at[1]}
            found = found if new <= found else found | new
            known[at] = found
        return found

    def votes(self, sequence: list[int]) -> set[int]:
        """The sequences that share as many words in a row with ``sequence`` as their seed asks for."""
        following, link, length, shortest = self.next, self.link, self.length, self.shortest
        state = matched = 0
        found: set[int] = set()
        for word in sequence:
            if word < 0:
                state = matched = 0
                continue
            while word not in following[state]:
                if not state:
                    break
                state = link[state]
                matched = length[state]
            else:
                state, matched = following[state][word], matched + 1
                if matched >= shortest:
                    found |= self._voted(state, matched)
        return found


def _pair_index(item: list[int]) -> dict[tuple[int, int], list[int]]:
    """Positions of each pair of neighbouring words."""
    at: dict[tuple[int, int], list[int]] = defaultdict(list)
    for j, pair in enumerate(zip(item, item[1:])):
        at[pair].append(j)
    return dict(at)


def _runs(document: list[int], item: list[int], at: dict[tuple[int, int], list[int]]) -> list[tuple[int, int, int]]:
    """Maximal runs (document position, item position, length) of equal words, in document order: those of two words or
    more, and single words in line with one of them, between words that were replaced."""
    out: set[tuple[int, int, int]] = set()
    for k, pair in enumerate(zip(document, document[1:])):
        for j in at.get(pair, ()):
            if k and j and document[k - 1] == item[j - 1]:
                continue  # the run has begun before
            n, most = 2, min(len(document) - k, len(item) - j)
            while n < most and document[k + n] == item[j + n]:
                n += 1
            out.add((k, j, n))
    for k, j, n in list(out):
        for step, a, b in ((1, k + n, j + n), (-1, k - 1, j - 1)):
            missed = 0
            while missed <= MAX_GAP and 0 <= a < len(document) and 0 <= b < len(item):
                if document[a] == item[b]:
                    if missed == 0 or any(0 <= a + d < len(document) and 0 <= b + d < len(item) and document[a + d] == item[b + d] for d in (-1, 1)):
                        break  # a run of its own
                    out.add((a, b, 1))
                    missed = 0
                else:
                    missed += 1
                a, b = a + step, b + step
    return sorted(out)


def passages(document: list[int], item: list[int], at: dict[tuple[int, int], list[int]] | None = None) -> list[tuple[int, int, int, int, int]]:
    """The one or two passages of ``document`` that hold most words of ``item`` in its order.

    Each is (matched words, document from, to, item from, to). A passage chains runs with up to ``MAX_GAP`` replaced words
    between them, at most one in seven over all (one more for the rounding of short passages).
    """
    chains: list[tuple[float, int, int, int, int, int, int]] = []  # score, matched, replaced, document from, to, item from, to
    recent: list[int] = []
    for k, j, n in _runs(document, item, _pair_index(item) if at is None else at):
        best = (float(n), n, 0, k, k + n, j, j + n)
        recent = [c for c in recent if chains[c][4] + MAX_GAP >= k]
        for c in recent:
            score, matched, replaced, k0, k1, j0, j1 = chains[c]
            gap_d, gap_i = k - k1, j - j1
            if 0 <= gap_d <= MAX_GAP and 0 <= gap_i <= MAX_GAP and (gap_d or gap_i):
                lost = max(gap_d, gap_i)
                if score + n - 2 * lost > best[0]:
                    best = (score + n - 2 * lost, matched + n, replaced + lost, k0, k + n, j0, j + n)
        recent.append(len(chains))
        chains.append(best)
    least = least_passage(len(item))
    kept = [(m, k0, k1, j0, j1) for _, m, r, k0, k1, j0, j1 in chains if m >= least and r <= (m + r) / REPLACED_ONE_IN + 1]
    kept.sort(reverse=True)
    top: list[tuple[int, int, int, int, int]] = []
    best = 0
    for i, a in enumerate(kept):
        if best >= len(item) or 2 * a[0] <= best:  # no pair from here on can hold more
            break
        other = next((b for b in kept[i + 1 :] if (b[2] <= a[1] or a[2] <= b[1]) and (b[4] <= a[3] or a[4] <= b[3])), None)
        pair = [a, other] if other else [a]
        total = sum(p[0] for p in pair)
        if total > best:
            top, best = pair, total
    return top


class Matcher:
    """Finds the items of one shard in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float) -> None:
        lists = [(i, words(t)) for i, t in items if t]
        lists = [(i, w) for i, w in lists if len(w) > 1]
        self.vocabulary: dict[str, int] = {}
        for _, w in lists:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        self.ids = [i for i, _ in lists]
        self.items = [[self.vocabulary[x] for x in w] for _, w in lists]
        self.pairs = [_pair_index(w) for w in self.items]
        self.share = share
        self.automaton = SuffixAutomaton(self.items, [seed_length(len(w), share) for w in self.items])

    def find(self, text: str | None, ranges: bool = True) -> list[tuple[int, float, list[tuple[int, int, int, int, int]], list[tuple[int, int]]]]:
        """(item id, share of the item's words, passages, their ranges in the text if wanted) of every item that the text repeats."""
        if not text or not self.items:
            return []
        get = self.vocabulary.get
        document = [get(w, -1) for w in words(text, self.vocabulary)]
        votes = self.automaton.votes(document)
        if not votes:
            return []
        held, out, places = set(zip(document, document[1:])), [], None
        for k in sorted(votes):
            item, least = self.items[k], needed_words(len(self.items[k]), self.share)
            # m matched words in two passages form at most (m + 14) / 6 + 2 runs, so they hold this many pairs of words
            if sum(len(self.pairs[k][pair]) for pair in self.pairs[k].keys() & held) < least - (least + 14) / (REPLACED_ONE_IN - 1) - 2:
                continue
            found = passages(document, item, self.pairs[k])
            matched = sum(p[0] for p in found)
            if found and matched >= least:
                if ranges:
                    places = places or placed_words(text, self.vocabulary)
                out.append((self.ids[k], matched / len(item), found, [(places[p[1]][1], places[p[2] - 1][2]) if places else (None, None) for p in found]))
        return out


_LAST: dict[tuple[str, float], Matcher] = {}


def _matcher(key: str, items: list[tuple[int, str]], share: float) -> Matcher:
    """The matcher of a shard; a Python worker keeps the last one it built."""
    if (key, share) not in _LAST:
        _LAST.clear()
        _LAST[key, share] = Matcher(items, share)
    return _LAST[key, share]


def _shards(documents: DataFrame, items: DataFrame, shard_words: int) -> list[tuple[str, object]]:
    """(key, broadcast items) of each shard; the driver holds one partition of items and one shard at a time."""
    sc = documents.sparkSession.sparkContext
    ship_package(documents.sparkSession)
    out, part, size = [], [], 0
    for item, text in items.select(F.col("item_id").cast("bigint"), "text").filter(F.col("text").isNotNull()).toLocalIterator():
        n = len(words(text))
        if part and size + n > shard_words:
            out.append((uuid.uuid4().hex, sc.broadcast(part)))
            part, size = [], 0
        part.append((item, text))
        size += n
    return [*out, (uuid.uuid4().hex, sc.broadcast(part))] if part else out


def _searched(batches: Iterator[pa.RecordBatch], shards: list, share: float, ranges: bool) -> Iterator[tuple[list, list, list[list]]]:
    """(document ids, texts, findings of each text) for batches of documents, a bounded number of characters at a time."""

    def search(ids: list, texts: list) -> tuple[list, list, list[list]]:
        found: list[list] = [[] for _ in texts]
        for key, items in shards:
            matcher = _matcher(key, items.value, share)
            for own, text in zip(found, texts):
                own += matcher.find(text, ranges)
        return ids, texts, found

    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            held += len(text or "")
            if held >= (BUFFER_CHARS if len(shards) > 1 else BUFFER_CHARS >> 5):
                yield search(ids, texts)
                ids, texts, held = [], [], 0
    yield search(ids, texts)


_PASSAGE = ("words", "doc_from", "doc_to", "item_from", "item_to", "start", "stop")
RESULT_SCHEMA = "doc_id bigint, item_id bigint, share double, passages array<struct<" + ",".join(f"{n}:int" for n in _PASSAGE) + ">>"


def find_leaks(documents: DataFrame, items: DataFrame, share: float = MIN_SHARE, shard_words: int = SHARD_WORDS, ranges: bool = False) -> DataFrame:
    """(doc_id, item_id, share, passages): every document with every item it repeats. A passage has its number of matched
    words, its word positions in document and item (ends exclusive) and, if wanted, its range of characters in the document.

    Reads the items when called.
    """
    shards = _shards(documents, items, shard_words)
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in _PASSAGE]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, found in _searched(batches, shards, share, ranges):
            rows = [(doc, item, covered, [dict(zip(_PASSAGE, (*p, *s))) for p, s in zip(ps, spans)]) for doc, own in zip(ids, found) for item, covered, ps, spans in own]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), kind))], names=["doc_id", "item_id", "share", "passages"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("text").isNotNull())).mapInArrow(scan, RESULT_SCHEMA)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given ranges of characters, which are in order and apart."""
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    return "".join([*kept, text[last:]])


def remove_leaks(documents: DataFrame, items: DataFrame, share: float = MIN_SHARE, drop_share: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text, leaked_items, dropped): documents with leaked passages cut out of them, from the first to the last
    character of a passage; everything else stays as it is. A document more than ``drop_share`` of whose words are in such
    passages is dropped as a whole (null text). Other documents pass unchanged."""
    shards = _shards(documents, items, shard_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sources, every in _searched(batches, shards, share, True):
            texts, dropped = [], []
            for text, found in zip(sources, every):
                spans = merged([s for _, _, _, own in found for s in own])
                drop = False
                if spans:
                    places = [(a, b) for _, a, b in placed_words(text)]
                    drop = sum(any(a < stop and start < b for start, stop in spans) for a, b in places) > drop_share * len(places)
                texts.append(None if drop else cut(text, spans) if spans else text)
                dropped.append(drop)
            leaked = [[item for item, *_ in found] for found in every]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(leaked, pa.list_(pa.int64())), pa.array(dropped, pa.bool_())],
                names=["doc_id", "text", "leaked_items", "dropped"],
            )

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(scan, "doc_id bigint, text string, leaked_items array<bigint>, dropped boolean")
