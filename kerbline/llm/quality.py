"""Problem 8: per-document text statistics that tell prose from lists, tables and junk.

One pass counts words, symbols, lines and more in the blocks (parts between blank lines) of every document.
``text_statistics`` adds the counts up to statistics of the document. ``find_non_prose`` models the standardised statistics
of the blocks by a Gaussian mixture fitted by expectation-maximisation, its components are mapped to kinds by inspected
examples of every kind, and a document is named after the kind of most of its non-prose text if that is more than half
of its text. Words are runs of letters, marks and digits, perhaps with an apostrophe inside; in Japanese text, which has no
blanks, runs of hiragana, of katakana and of ideographs are words, and those of hiragana count as function words.

Scale: the statistics of every block of every document are computed once, in one narrow pass, and persisted. Each round of
expectation-maximisation is a pass over them that gives one row of sums a partition, added up on the driver; every
document is then classified from the same statistics, without a shuffle. The model that tasks receive is a few kilobytes.

Defined results: null, empty and blank texts have no kind and count as no words, lines or shares of 0; a text of any
length is read whole; repeated rows repeat; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kerbline.llm.inspected import examples
from kerbline.session import ship_package, spread

KINDS = ("prose", "list", "table", "junk")

# fixed values: frequent function words of the corpus languages
COMMON_WORDS = {
    "en": "the a an and or of to in on at by for from with without as is are was were be been it its this that these those he she we i you they "
    "not no but so if then than when while until because although after before between behind under over into near next close what who which why how "
    "our their there here where had has have did do does will would can could up out off all most some any one",
    "de": "der die das den dem des ein eine einen einem einer und oder in im an am auf aus bei beim mit ohne zu zum zur von vom für ist sind war wird "
    "nicht kein keine aber auch als so wenn dann nach vor hinter unter über neben wegen trotz es sie er wir ich was wie warum nur noch bis ab dazu darum deshalb also etwa nochmals",
    "fr": "le la les l un une des du de d et ou à au aux en dans sur sous par pour avec sans est sont était ne pas plus mais donc si que qui quoi ce cette "
    "ces il elle on nous vous je reste après avant derrière près malgré alors personne n c s pendant juste",
    "es": "el la los las un una unos de del y o a al en con sin por para es son era no más pero si que quien esta este esto se lo le su sus nos yo después "
    "antes detrás cerca aunque así durante hasta unos sigue",
}
_COMMON = frozenset(w for text in COMMON_WORDS.values() for w in text.split())

_CJK = r"\p{Hiragana}\p{Katakana}\p{Han}ー"
_OTHER = rf"[[\p{{L}}\p{{N}}]--[{_CJK}]][[\p{{L}}\p{{M}}\p{{N}}]--[{_CJK}]]*+"
_WORD = regex.compile(rf"(?V1)(?:\p{{Hiragana}}\p{{M}}*+)++|(?:[\p{{Katakana}}ー]\p{{M}}*+)++|(?:\p{{Han}}\p{{M}}*+)++|{_OTHER}(?:['’]{_OTHER})?")
_HIRAGANA = regex.compile(r"\p{Hiragana}")
_BLOCKS = regex.compile(r"\n[ \t\r\f\v]*+\n\s*+")
_SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\p{Cf}\U0001F000-\U0001FAFF\u2600-\u27BF\u2300-\u23FF\u2B00-\u2BFF\s.,;:!?'\"()\-–—…、。！？「」’‘“”¿¡]")
_ODD_CHAR = regex.compile(r"[\p{Cc}\p{Co}\p{Cn}�▀-◿\u0080-¦¨-º¼-¾×÷ÂÃâ€](?<![\n\t\r])")
_ODD_WORD = regex.compile(
    r"[^\W_]*?(?:\p{Ll}\p{Lu}|\p{L}\p{Nd}|\p{Nd}\p{L}|q(?!u)|[jqvx][bcdfghjklmnpqrstvwxz]|[bcdfghjkmnpqstvwxz]{4}|[bcdfgkmnptvz][jqx])[^\W_]*+"
    r"|[bcdfghjklmnpqrstvwxz]{3,}|(?=[a-f]*\d?[a-f])[0-9a-f]{2}"
)
_MARKER = regex.compile(r"\s*+(?:[-*•‣·–+▪◦]\s|\[[ xX]?\]|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s)")
_ENDED = re.compile(r"[.!?…。！？:;][\"'”’)»]*[^\S\n]*$", re.M)
_PART = re.compile(r"[,;、|\t\n]|\s{2,}")
_GAP = re.compile(r"\S(?:\t|  +)(?=\S)|\t")
_ITEM, _CELL, _ROW = regex.compile(r"<li\b[^<>]*>", regex.I), regex.compile(r"<t[dh]\b[^<>]*>", regex.I), regex.compile(r"<tr\b[^<>]*>", regex.I)
_TAG = regex.compile(r"</?(?:p|div|span|b|i|u|em|strong|br|ul|ol|li|td|th|tr|table|tbody|thead|h[1-6]|a|s|unk|code|pre|blockquote)\b[^<>]*>|<\|[a-z_]+\|>", regex.I)
_ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?")
_LATIN_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_NOT_SYMBOL = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in " \t\n\r\f\v.,;:!?'\"()-\x1c\x1d\x1e\x1f")
_NOT_DIGIT = bytes(c for c in range(256) if c not in b"0123456789")
_BLANK = bytes(c for c in range(128) if chr(c).isspace())
_NOT_CONTROL = bytes(c for c in range(128) if 32 <= c < 127 or c in b"\t\n\r")
_MARKS = frozenset("-*•‣·–+▪◦[(") | frozenset("0123456789") | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_IDEOGRAPH = regex.compile(rf"[{_CJK}]")
FEATURES = 14
#: Words in a window in which repetition is measured, so that a long text is no more repetitive than a short one.
WINDOW = 40


def blocks(text: str) -> list[str]:
    """Parts of a text between blank lines."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:  # markup becomes layout
        text = _TAG.sub("", _ITEM.sub("\n- ", _CELL.sub("|", _ROW.sub("\n", text))))
    return [b for b in _BLOCKS.split(text) if b.strip()]


def _regular(counts: list[int]) -> tuple[float, int]:
    """Share of lines with the most frequent positive count, and that count."""
    best, times = 0, 0
    for c in set(counts):
        n = counts.count(c)
        if c and (n, c) > (times, best):
            best, times = c, n
    return times / len(counts), best


class _Flags(dict):
    """For a word: 1 if it is a function word, plus 2 ** 32 if it looks odd. Forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        low = word.lower()
        common = low in _COMMON or bool(_HIRAGANA.match(word))
        self[word] = flags = common + (bool(low not in _COMMON and _ODD_WORD.fullmatch(word)) << 32)
        return flags


_FLAGS = _Flags()

#: What a character can be, as bits of its class.
SYMBOL, DIGIT, ODD, BLANK, JAPANESE, MARK = 1, 2, 4, 8, 16, 32


class _Classes(dict):
    """For a character's code: the class of the character, as a character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        bits = (
            bool(_SYMBOL.match(c)) * SYMBOL | c.isdecimal() * DIGIT | bool(_ODD_CHAR.match(c)) * ODD | c.isspace() * BLANK | bool(_IDEOGRAPH.match(c)) * JAPANESE
            | (unicodedata.category(c)[0] == "M") * MARK
        )
        self[code] = found = chr(64 + bits)
        return found


_CLASSES = _Classes()


def character_counts(text: str) -> list[int]:
    """How many characters of a text have each of the bits of ``_Classes``."""
    classes = text.translate(_CLASSES)
    out = [0] * 6
    for c in set(classes):
        bits, n = ord(c) - 64, classes.count(c)
        for k in range(6):
            if bits >> k & 1:
                out[k] += n
    return out


def block_counts(block: str) -> tuple[list[float], tuple[int, ...]]:
    """(statistics of a block that the mixture models, the counts that add up to those of the document)."""
    lines = [x for x in block.split("\n") if x.strip()]
    n_lines = len(lines)
    ascii_only = block.isascii()
    ideographs = unusual = False
    if ascii_only:  # the same counts by deletion
        raw = block.encode()
        solid, symbols, digits, odd_chars = (len(raw.translate(None, x)) for x in (_BLANK, _NOT_SYMBOL, _NOT_DIGIT, _NOT_CONTROL))
    else:
        symbols, digits, odd_chars, blank, japanese, marks = character_counts(block)
        solid, ideographs, unusual = len(block) - blank, japanese > 0, japanese + marks > 0
    found = (_ASCII_WORD if ascii_only else _WORD if unusual else _LATIN_WORD).findall(block)
    n = len(found)
    joined = " ".join(found)
    letters = len(joined) - n + 1 if n else 0
    lower = joined.lower().split(" ") if n else []
    flags = sum(map(_FLAGS.__getitem__, found))
    common, odd_words = flags & 0xFFFFFFFF, flags >> 32
    solid = solid or 1
    ends = len(_ENDED.findall(block))
    cells, width = 0.0, 0
    if n_lines > 1:
        for d in "|\t;,&│":
            if d in block:
                share, c = _regular([x.count(d) for x in lines])
                if c > 1 or share > 0.9:
                    cells, width = max((cells, width), (share, c))
        if "  " in block or "\t" in block:
            # columns parted by blanks have gaps in most lines, though empty cells hide some
            gaps = [len(_GAP.findall(x.strip())) if "  " in x or "\t" in x else 0 for x in lines]
            cells, width = max((cells, width), (sum(1 for g in gaps if g > 0) / n_lines * 0.9, max(gaps)))
    marked = 0
    for i, x in enumerate(lines):
        if x.lstrip()[0] in _MARKS and (mark := _MARKER.match(x)):
            marked += 1
            lines[i] = x[mark.end() :]
    body = "\n".join(lines)
    if ascii_only and "  " not in body:  # the same by faster means
        for d in ",;|\t":
            if d in body:
                body = body.replace(d, "\n")
        parts = [p for p in body.split("\n") if p and not p.isspace()]
    else:
        parts = [p for p in _PART.split(body) if p and not p.isspace()]
    if ideographs:  # three ideographs or kana count as a word
        short = sum(1 for p in parts if len(p.split()) + len(_IDEOGRAPH.findall(p)) // 3 <= 4)
    else:
        short = sum(1 for p in parts if len(p.split()) <= 4)
    if n <= WINDOW:
        distinct = len(set(lower)) / n if n else 0.0
    else:
        windows = [lower[i : i + WINDOW] for i in range(0, n, WINDOW)]
        windows = windows[:-1] if len(windows[-1]) < WINDOW // 2 else windows
        distinct = sum(len(set(w)) / len(w) for w in windows) / len(windows)
    return _statistics(n, n_lines, letters, symbols, digits, solid, common, ends, cells, width, distinct, odd_words, odd_chars, short, len(parts), marked), (
        n, letters, symbols, solid, ends, n_lines, common,
    )


def _statistics(
    n: int, n_lines: int, letters: int, symbols: int, digits: int, solid: int, common: int, ends: int, cells: float, width: int, distinct: float, odd_words: int, odd_chars: int, short: int, parts: int, marked: int
) -> list[float]:
    return [
        common / n if n else 0.0,
        math.log1p(min(40.0, n / n_lines)) if n_lines else 0.0,
        min(20.0, letters / n) if n else 0.0,
        symbols / solid,
        digits / solid,
        ends / n_lines if n_lines else 0.0,
        cells,
        math.log1p(min(width, 8)),
        distinct,
        odd_words / n if n else 0.0,
        min(1.0, odd_chars / solid),
        short / parts if parts else 0.0,
        marked / n_lines if n_lines else 0.0,
        math.log1p(min(parts, 12)),
    ]


def block_statistics(block: str) -> list[float]:
    """The statistics of a block that the mixture models."""
    return block_counts(block)[0]


class Mixture:
    """Gaussian mixture with diagonal covariances over standardised statistics."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> None:
        self.centre, self.scale, self.weights, self.means, self.variances = centre, scale, weights, means, variances
        self.kind_of = np.zeros(len(weights), dtype=int)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight x density of each component, for rows of raw statistics."""
        return self._log_densities(self.powers(x))

    def powers(self, x: np.ndarray) -> np.ndarray:
        """One, the standardised statistics and their squares, side by side."""
        z = (x - self.centre) / self.scale
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def _log_densities(self, powers: np.ndarray) -> np.ndarray:
        inverse = 1 / self.variances
        constant = np.log(self.weights) - 0.5 * ((self.means**2 * inverse).sum(1) + np.log(self.variances).sum(1) + self.means.shape[1] * np.log(2 * np.pi))
        return powers @ np.hstack([constant[:, None], self.means * inverse, -0.5 * inverse]).T

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        log = self.log_densities(x)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def kinds(self, x: np.ndarray) -> np.ndarray:
        """Index of the likeliest kind of each row: the components of a kind count together."""
        p = self.responsibilities(x)
        each = np.stack([p[:, self.kind_of == k].sum(axis=1) for k in range(len(KINDS))], axis=1)
        return each.argmax(axis=1)


def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sum of squared deviations) of each statistic."""
    centre = x.mean(axis=0)
    return len(x), centre, ((x - centre) ** 2).sum(axis=0)


def merge_moments(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the rows of both."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart**2 * (a[0] * b[0] / n)


def round_sums(model: Mixture, x: np.ndarray) -> np.ndarray:
    """What a round of expectation-maximisation needs of some rows: per component its mass, first and second moments
    (standardised), and in a last row the sum of the log likelihoods. Sums of parts add up."""
    powers = model.powers(x)
    p = model._log_densities(powers)
    top = p.max(axis=1, keepdims=True)
    np.exp(np.subtract(p, top, out=p), out=p)
    total = p.sum(axis=1, keepdims=True)
    p /= total
    sums = p.T @ powers
    return np.vstack([sums, np.full((1, sums.shape[1]), (np.log(total) + top).sum())])


def fit_mixture_by(
    found: tuple[int, np.ndarray, np.ndarray] | None, sums_of: Callable[[Mixture], np.ndarray], start: np.ndarray, rounds: int = 25, floor: float = 0.05, anchor: float = 20.0
) -> Mixture:
    """Expectation-maximisation from components at the rows of ``start`` (raw statistics of inspected forms), over rows
    of which ``found`` has the moments (None: there are no rows) and ``sums_of`` gives the ``round_sums`` under a model.

    Each start counts as ``anchor`` observations of its own component, so that a rare form keeps its component;
    ``floor`` keeps variances positive for statistics that are constant in a component.
    """
    n, centre, squares = merge_moments(found, moments(start)) if found else moments(start)
    scale = np.sqrt(squares / n)
    scale = np.where(scale > 1e-9, scale, 1.0)
    anchors = (start - centre) / scale
    k, width = start.shape
    model = Mixture(centre, scale, np.full(k, 1 / k), anchors.copy(), np.full((k, width), 0.3))
    before = -np.inf
    for _ in range(rounds if found else 0):
        sums = sums_of(model)
        mass = sums[:k, 0] + anchor
        means = (sums[:k, 1 : width + 1] + anchor * anchors) / mass[:, None]
        second = (sums[:k, width + 1 :] + anchor * anchors**2) / mass[:, None]
        model = Mixture(centre, scale, mass / mass.sum(), means, np.maximum(second - means**2, 0) + floor)
        likelihood = float(sums[k, 0] / found[0])
        if likelihood - before < 1e-4:
            break
        before = likelihood
    return model


def fit_mixture(x: np.ndarray, start: np.ndarray, rounds: int = 25, floor: float = 0.05, anchor: float = 20.0) -> Mixture:
    """``fit_mixture_by`` over the rows of ``x``."""
    return fit_mixture_by(moments(x) if len(x) else None, lambda model: round_sums(model, x), start, rounds, floor, anchor)


def map_components(model: Mixture, x: np.ndarray, kinds: np.ndarray) -> None:
    """Give each component the kind of the inspected blocks it is responsible for, weighted by responsibility."""
    p = model.responsibilities(x)
    votes = np.stack([p[kinds == k].sum(axis=0) / max(1, (kinds == k).sum()) for k in range(len(KINDS))], axis=1)
    nearest = ((((x - model.centre) / model.scale)[None, :, :] - model.means[:, None, :]) ** 2).sum(axis=2).argmin(axis=1)
    model.kind_of = np.where(votes.max(axis=1) > 1e-6, votes.argmax(axis=1), kinds[nearest])


def inspected_statistics() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean statistics per inspected form, statistics of all inspected blocks, their kinds)."""
    starts, rows, kinds = [], [], []
    for kind, texts in examples():
        own = [block_statistics(b) for t in texts for b in blocks(t)]
        starts.append(np.mean(own, axis=0))
        rows += own
        kinds += [KINDS.index(kind)] * len(own)
    return np.array(starts), np.array(rows), np.array(kinds)


#: Observations that each start counts as for every so many documents. Among more documents it counts as more, in proportion:
#: with a fixed number the starts would lose their weight as the input grows, and components of rare forms drift into prose.
ANCHOR, ANCHOR_DOCS = 20.0, 20_000
#: Rows of statistics that a pass holds at once.
ROWS_AT_ONCE = 4096


#: Counts of a document: words, their characters, symbols, characters but white space, lines that end a sentence, lines that
#: are not blank, function words.
COUNTS = 7


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, sizes, statistics, counts) of every document: the characters of its blocks and, end to end, their statistics;
    its counts (see ``COUNTS``). Without text the first two are empty and the counts 0."""
    ship_package(documents.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                every = [blocks(t) if t else [] for t in part.column(1).to_pylist()]
                sizes = [[len(b) for b in own] for own in every]
                found = [[block_counts(b) for b in own] for own in every]
                rows = [[v for x, _ in own for v in x] for own in found]
                counts = [list(map(sum, zip(*(c for _, c in own)))) or [0] * COUNTS for own in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.list_(pa.int32())), pa.array(rows, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64()))],
                    names=["doc_id", "sizes", "statistics", "counts"],
                )

    texts = documents.select(F.col("doc_id").cast("bigint"), "text")
    return spread(texts).mapInArrow(scan, "doc_id bigint, sizes array<int>, statistics array<double>, counts array<bigint>")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The block statistics of batches with the one column ``statistics``, a bounded number of rows at a time."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
        yield from (x[i : i + ROWS_AT_ONCE] for i in range(0, len(x), ROWS_AT_ONCE))


def _collected(statistics: DataFrame, per_part: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> list[np.ndarray]:
    """One array of numbers from each partition that has any rows, in order of the partitions."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = per_part(_rows_of(batches))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.ravel().tolist()], pa.list_(pa.float64()))], names=["s"])

    return [np.array(r.s) for r in statistics.select("statistics").mapInArrow(scan, "s array<double>").collect()]


def fit_model(statistics: DataFrame) -> Mixture:
    """The mixture fitted to all blocks of ``document_statistics``; one row of sums a partition reaches the driver."""
    starts, rows, kinds = inspected_statistics()

    with_text = statistics.filter(F.size("sizes") > 0).count()

    def part_moments(parts: Iterator[np.ndarray]) -> np.ndarray | None:
        found = None
        for x in parts:
            found = merge_moments(found, moments(x)) if found else moments(x)
        return np.concatenate([[found[0]], found[1], found[2]]) if found else None

    found = None
    for m in _collected(statistics, part_moments):
        own = (int(m[0]), m[1 : FEATURES + 1], m[FEATURES + 1 :])
        found = merge_moments(found, own) if found else own

    def sums_of(model: Mixture) -> np.ndarray:
        def part_sums(parts: Iterator[np.ndarray]) -> np.ndarray | None:
            sums = None
            for x in parts:
                sums = round_sums(model, x) if sums is None else sums + round_sums(model, x)
            return sums

        return sum(_collected(statistics, part_sums)).reshape(len(starts) + 1, 2 * FEATURES + 1)

    anchor = ANCHOR * max(1.0, with_text / ANCHOR_DOCS)
    model = fit_mixture_by(found, sums_of, starts, anchor=anchor)
    map_components(model, rows, kinds)
    return model


def kinds_of(model: Mixture, sizes: list[list[int]], statistics: np.ndarray) -> list[tuple[str | None, list[float]]]:
    """(kind, share of each kind's text) of each document, of the sizes of its blocks and the statistics of all blocks in
    order; the kind is None for a text without content."""
    found = iter(model.kinds(statistics).tolist() if len(statistics) else [])
    out: list[tuple[str | None, list[float]]] = []
    for own in sizes:
        if not own:
            out.append((None, [0.0] * len(KINDS)))
            continue
        size = [0] * len(KINDS)
        for n in own:
            size[next(found)] += n
        shares = [x / sum(size) for x in size]
        out.append(("prose" if shares[0] >= 0.5 else max(KINDS[1:], key=lambda k: shares[KINDS.index(k)]), shares))
    return out


def document_kinds(model: Mixture, texts: list[str | None]) -> list[tuple[str | None, list[float]]]:
    """``kinds_of`` of texts."""
    parts = [blocks(t) if t else [] for t in texts]
    return kinds_of(model, [[len(b) for b in own] for own in parts], np.array([block_statistics(b) for own in parts for b in own]))


def classify(statistics: DataFrame, model: Mixture) -> DataFrame:
    """(doc_id, kind, shares): the kind of every document with content and the shares of its text by kind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                found = kinds_of(model, part.column(1).to_pylist(), x)
                rows = [(doc, *x) for doc, x in zip(part.column(0).to_pylist(), found) if x[0] is not None]
                ids, kinds, shares = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "kind", "shares"])

    return statistics.select("doc_id", "sizes", "statistics").mapInArrow(scan, "doc_id bigint, kind string, shares array<double>")


def find_non_prose(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents more than half of whose text is list, table or junk.

    Fits the mixture when called; the persisted statistics serve the result too and are freed with Spark's cache.
    """
    statistics = document_statistics(documents).persist(StorageLevel.MEMORY_AND_DISK)
    return classify(statistics, fit_model(statistics)).filter(F.col("kind") != "prose").select("doc_id", "kind")


def text_statistics(documents: DataFrame) -> DataFrame:
    """Statistics of every document, from the counts of its blocks.

    doc_id, n_words, mean_word_length, symbol_ratio (characters that are no letters, marks, digits, white space, pictographs or
    plain punctuation, of all that are no white space), punctuated_lines (share of non-blank lines that end a sentence),
    common_share (share of words that are frequent function words). Markup is no text. Null text counts as empty.
    """
    n, letters, symbols, solid, ends, lines, common = (F.get("counts", F.lit(i)) for i in range(COUNTS))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return document_statistics(documents).select(
        "doc_id",
        n.alias("n_words"),
        share(letters, n).alias("mean_word_length"),
        share(symbols, solid).alias("symbol_ratio"),
        share(ends, lines).alias("punctuated_lines"),
        share(common, n).alias("common_share"),
    )
