"""Evaluation items inside a corpus of scanned pages: a suffix automaton over the items, streamed over each column.

The items are a given, small table; their automaton over words (at most twice as many states as words) goes to every
task. A page is first put into reading order: columns are found from the boxes of its lines, lines that run across
columns are divided at the gaps, words broken at line ends are joined. Words are compared without case, punctuation
and accents, by letter classes that a scan confuses, and where symbols are in the wrong encoding by the other letters. For each word the automaton gives the longest run of words up to it that
stands in some item; where an advert interrupts a column the run may go on after it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARACTERS = 20_000_000  # of all items together
LEAST = 12  # consecutive words, or a whole shorter item
SEED = 3  # shortest run kept for joining across an interruption
GAP_LINES = 12  # whole lines that may interrupt a run
BREAKS = "-¬=­‐‑"  # marks of a word broken at a line end
INDENT = 12  # pixels by which an advert's line is set off its column
#: Letters that a scan confuses, each group counted as its first member (after lower case).
PAIRS = (("rn", "m"), ("vv", "w"))
GROUPS = ("ceao0", "il1", "tfs5", "un", "hb8", "gq", "vy")
_FOLD = str.maketrans({ch: g[0] for g in GROUPS for ch in g})
#: Latin letters that have no decomposition.
_PLAIN = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "ı": "i", "æ": "ae", "œ": "oe", "ß": ""})


def _classes(letters: str) -> str:
    for a, b in PAIRS:
        letters = letters.replace(a, b)
    return letters.translate(_FOLD).replace("tt", "")  # sharp s is left out, so is its spelling ss


def fold(word: str) -> str:
    """A word as it is compared: lower case, letters and digits only, accents taken off, letters a scan confuses made
    equal; letters of other scripts stay. Empty for what is no word."""
    low = word.lower()
    if low.isascii():
        return _classes("".join(ch for ch in low if ch.isalnum())) or ("~" if any(ch.isalnum() for ch in low) else "")
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", low.translate(_PLAIN)) if ch.isalnum())
    if not plain or (not any(ch.isascii() for ch in plain) and 2 * sum(ch.isalnum() for ch in low) < len(low)):
        return ""  # marks, among them a dash in the wrong encoding
    return _classes(plain) or "~"


def skeleton(word: str) -> str:
    """The ASCII letters of a word: what is left of it where the others are in the wrong encoding."""
    return _classes("".join(ch for ch in word.lower() if ch.isascii() and ch.isalnum()))


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words: dict[str, int] = {}
        self.bare: dict[str, int] = {}  # by the ASCII letters of words that have others
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        self.size: dict[int, int] = {}
        short: list[tuple[int, int]] = []
        for item, text in items:
            seq = [self._add(w, t) for w, t in ((fold(t), t) for t in (text or "").split()) if w]
            if not seq:
                continue
            self.size[item] = len(seq)
            last = 0
            for pos, w in enumerate(seq):
                last = self._extend(last, w, ends)
                ends[last].append((item, pos))
            if len(seq) < LEAST:
                short.append((last, item))
        order = sorted(range(1, len(self.len)), key=lambda s: -self.len[s])
        for s in order:  # end positions go up the suffix links, longest first
            if self.len[s] >= 1 and self.link[s] > 0:
                ends[self.link[s]].extend(ends[s])
        self.ends = [frozenset(e) for e in ends]
        # short items that end wherever a state does, down the suffix links
        self.whole: list[tuple[int, ...]] = [()] * len(self.len)
        own = defaultdict(list)
        for s, item in short:
            own[s].append(item)
        for s in reversed(order):
            up = self.whole[self.link[s]] if self.link[s] > 0 else ()
            self.whole[s] = (*up, *own[s])

    def _add(self, w: str, word: str) -> int:
        k = self.words.setdefault(w, len(self.words))
        if not word.isascii():
            self.bare.setdefault(skeleton(word), k)
        return k

    def lookup(self, word: str) -> int:
        """Number of a page's word among the items' words; -1 if it is none of them, -2 if it is no word. A word with
        symbols outside ASCII that is none as it stands may be one of theirs in the wrong encoding."""
        w = fold(word)
        if not w:  # a line or a root sign stands for a letter only where the encoding is wrong
            strange = any(ch > "\xff" and unicodedata.category(ch) in ("Sm", "So") for ch in word)
            return self.bare.get("", -2) if strange else -2
        k = self.words.get(w)
        if k is None and not word.isascii():
            k = self.bare.get(skeleton(word))
        return -1 if k is None else k

    def _new(self, length: int, ends: list) -> int:
        self.next.append({}), self.len.append(length), self.link.append(0), ends.append([])
        return len(self.len) - 1

    def _extend(self, last: int, w: int, ends: list) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the word sequence is known from an earlier item
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q, ends)
        cur = self._new(self.len[last] + 1, ends)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q, ends)
        return cur

    def _clone(self, p: int, w: int, q: int, ends: list) -> int:
        c = self._new(self.len[p] + 1, ends)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c


PIECE = re.compile(r"\S+(?:[^\S\t]\S+)*")
Boxes = list[tuple[int, int, int] | None] | list[dict | None]  # left, right and upper edge, or the struct itself


def columns(text: str, boxes: Boxes | None) -> list[list[tuple[int, int, int, bool]]]:
    """Reading order: for each column its pieces (line number, start, end, set off), top to bottom.

    Starts of columns are where lines begin: left edges more than 100 pixels apart form groups. A line that runs
    across columns shows gaps of two or more blanks; each piece goes to the column whose start is nearest to where it
    should begin, given the width of a character, and pieces that together fit a column stay together. Lines without
    a box count as one column in the order given.
    """
    lines = text.split("\n")
    if boxes and isinstance(boxes[0], dict):
        boxes = [b and (b["x0"], b["x1"], b["y0"]) for b in boxes]
    if not boxes or len(boxes) != len(lines) or any(b is None or None in b for b in boxes):
        return [[(no, 0, len(ln), False) for no, ln in enumerate(lines)]]
    left = min(b[0] for b in boxes)
    spans = []
    widths = []
    for ln, (x0, x1, _) in zip(lines, boxes):
        if "  " in ln or "\t" in ln or not ln:
            parts = [(m.start(), m.end()) for m in PIECE.finditer(ln)]
        else:
            end = len(ln.rstrip())
            parts = [(len(ln) - len(ln.lstrip()), end)] if end else []
        spans.append(parts)
        if len(parts) == 1 and len(ln) > 8:
            widths.append((x1 - x0) / len(ln))
    single = [b[0] for p, b in zip(spans, boxes) if len(p) <= 1]
    starts: list[int] = []
    for x in sorted([left, *single]):
        if not starts or x - starts[-1] > 100:
            starts.append(x)
    most = max((len(p) for p in spans), default=1)
    if most > 1:
        # pages whose lines run together: how many columns there are shows in the widest common division
        counts = defaultdict(int)
        for p in spans:
            counts[len(p)] += 1
        usual = max((k for k in counts if k > 1 and counts[k] >= 2), key=lambda k: (counts[k], k), default=most)
        cw = sorted(widths)[len(widths) // 2] if widths else 9.3
        if len(starts) < usual:
            wide = [(b[0], b[1], p, ln) for p, b, ln in zip(spans, boxes, lines) if len(p) == usual]
            for k in range(1, usual):
                # a last piece ends where its line's box ends, so the last column begins its own length before
                if k == usual - 1:
                    guess = sorted(x1 - (p[-1][1] - p[-1][0]) * cw for _, x1, p, _ in wide)
                    guess_at = guess[len(guess) // 2]
                else:
                    guess_at = left + (max(x1 for _, x1, _, _ in wide) - left) * k / usual
                if all(abs(guess_at - s) > 100 for s in starts):
                    starts.append(int(guess_at))
            starts.sort()
    n = len(starts)
    cols: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(n)]
    fits = 0
    if most > 1:
        fits = max((e - s for p in spans if len(p) == n for s, e in p), default=0)
    for no, (p, b) in enumerate(zip(spans, boxes)):
        if not p:
            continue
        first = min(range(n), key=lambda c: abs(starts[c] - b[0]))
        away = b[0] - starts[first] >= INDENT
        if len(p) == 1:
            cols[first].append((no, *p[0], away))
            continue
        across = b[1] - b[0]
        room = (starts[first + 1] if first + 1 < n else b[1] + 1) - b[0]
        if n == 1 or across <= room:  # the blanks stand inside one column
            cols[first].append((no, p[0][0], p[-1][1], away))
            continue
        groups = _divide(p, n - first, fits)
        for k, (s, e) in enumerate(groups):
            cols[min(first + k, n - 1) if k < len(groups) - 1 or len(groups) == n - first else n - 1 if b[1] > starts[n - 1] else min(first + k, n - 1)].append((no, s, e, away and k == 0))
    top = [b[2] for b in boxes]
    return [sorted(c, key=lambda piece: (top[piece[0]], piece[0])) for c in cols if c]


def _divide(parts: list[tuple[int, int]], most: int, fits: int) -> list[tuple[int, int]]:
    """Join neighbouring pieces until at most ``most`` are left, always the pair that is shortest together."""
    out = list(parts)
    while len(out) > max(1, most):
        k = min(range(len(out) - 1), key=lambda i: out[i + 1][1] - out[i][0])
        out[k : k + 2] = [(out[k][0], out[k + 1][1])]
    return out


def _stream(text: str, column: list[tuple[int, int, int, bool]], lines: list[str], offsets: list[int]) -> list[tuple[str, int, int, int]]:
    """Words of a column: (word, piece of the column it begins in, start, end in the text). A broken word is one word."""
    out: list[tuple[str, int, int, int]] = []
    held: tuple[str, int, int] | None = None
    for k, (no, s, e, _) in enumerate(column):
        words = lines[no][s:e].split()
        at = offsets[no] + s
        for i, w in enumerate(words):
            at = text.index(w, at)
            start, end = at, at + len(w)
            at = end
            if held is not None:
                w, first, start = held[0] + w, held[1], held[2]
                held = None
            else:
                first = k
            if i == len(words) - 1 and len(w) > 1 and w[-1] in BREAKS and k < len(column) - 1:
                held = (w[:-1], first, start)
                continue
            out.append((w, first, start, end))
    if held is not None:
        out.append((held[0], held[1], held[2], held[2] + len(held[0])))
    return out


def _numbers(auto: Automaton, cache: dict[str, int], column: list[tuple[int, int, int, bool]], lines: list[str]) -> tuple[list[int], list[int]]:
    """As ``_stream``, but only the numbers of the words and the piece each begins in."""
    ids: list[int] = []
    piece: list[int] = []
    held, first, last, known = "", 0, len(column) - 1, cache.get
    for k, (no, s, e, _) in enumerate(column):
        words = lines[no][s:e].split()
        if not words:
            continue
        at = k
        if held:
            words[0] = held + words[0]
            at, held = first, ""
        if k < last and len(words[-1]) > 1 and words[-1][-1] in BREAKS:
            held, first = words.pop()[:-1], at if len(words) == 0 else k
        got = list(map(known, words))
        if None in got:
            for n, w in enumerate(words):
                if got[n] is None:
                    got[n] = cache[w] = auto.lookup(w)
        where = [at, *([k] * (len(got) - 1))] if got else []
        if -2 in got:
            where = [z for z, v in zip(where, got) if v != -2]
            got = [v for v in got if v != -2]
        ids += got
        piece += where
    if held:
        v = auto.lookup(held)
        if v != -2:
            ids.append(v)
            piece.append(first)
    return ids, piece


def _runs(auto: Automaton, ids: list[int]) -> tuple[set[int], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(short items met whole, runs that cannot be extended: (last word, length) of at least SEED words,
    words that end a run of at least LEAST words: (word, state, length))."""
    nxt, link, length, whole = auto.next, auto.link, auto.len, auto.whole
    s = n = 0
    short: set[int] = set()
    runs: list[tuple[int, int]] = []
    deep: list[tuple[int, int, int]] = []
    for i, w in enumerate(ids):
        if w < 0:
            if n >= SEED:
                runs.append((i - 1, n))
            s = n = 0
            continue
        before = n
        if w not in nxt[s]:
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if before >= SEED:
                runs.append((i - 1, before))
        if w in nxt[s]:
            s = nxt[s][w]
            n += 1
        else:
            s = n = 0
        if n >= LEAST:
            deep.append((i, s, n))
        if s and whole[s]:
            for item in whole[s]:
                if auto.size[item] <= n:
                    short.add(item)
    if n >= SEED:
        runs.append((len(ids) - 1, n))
    return short, runs, deep


def _passages(auto: Automaton, deep: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(item, its last word, last word, length) of every passage of at least LEAST words that goes no further in its
    own item, whether or not it lies inside a longer run of another."""
    held: dict[tuple[int, int], int] = {}
    at = -1
    for i, s, n in [*deep, (-1, 0, 0)]:
        now: dict[tuple[int, int], int] = {}
        while s > 0 and auto.len[s] >= LEAST:  # the item ends of a suffix are those of its state, the longest suffix first
            for e in auto.ends[s]:
                now.setdefault(e, min(n, auto.len[s]))
            s = auto.link[s]
        for (item, end), length in held.items():
            if i != at + 1 or (item, end + 1) not in now:
                yield item, end, at, length
        held, at = now, i


def _spell(auto: Automaton, ids: list[int], last: int, n: int) -> int:
    """The state of the word run of length n that ends at ``last``."""
    s = 0
    for w in ids[last - n + 1 : last + 1]:
        s = auto.next[s][w]
    return s


def _continued(auto: Automaton, ids: list[int], piece: list[int], runs: list[tuple[int, int]]) -> set[tuple[int, tuple[int, int, int, int]]]:
    """(item, (first word, last word, first and last word in the item)) of the runs after or before which the item goes
    on across whole lines. Of two runs the one with fewer places in the items is listed, the other looked up."""
    out = set()
    states: dict[int, frozenset] = {}
    ends = lambda k: states[k] if k in states else states.setdefault(k, auto.ends[_spell(auto, ids, *runs[k])])
    for x, (last, n) in enumerate(runs):
        for y in range(x + 1, len(runs)):
            end, m = runs[y]
            first = end - m + 1
            skipped = piece[first] - piece[last]
            if skipped > GAP_LINES + 1:
                break
            if first - last <= 1 or skipped < 1:
                continue
            a, b = ends(x), ends(y)
            for lost in (0, 1):  # a word may be lost in a break
                step = m + lost
                both = [(i, e) for i, e in a if (i, e + step) in b] if len(a) <= len(b) else [(i, e - step) for i, e in b if (i, e - step) in a]
                for item, e in both:
                    out.add((item, (last - n + 1, last, e - n + 1, e)))
                    out.add((item, (first, end, e + lost + 1, e + step)))
    return out


def leaks_of(auto: Automaton, cache: dict[str, int], text: str, boxes: Boxes | None, spans: bool) -> dict[int, tuple[int, int, list[tuple[int, int]]]]:
    """item to (longest run, item words met, character spans) of a page's leaks."""
    lines = text.split("\n")
    offsets, at = [], 0
    for ln in lines:
        offsets.append(at)
        at += len(ln) + 1
    found: dict[int, list] = {}
    for column in columns(text, boxes):
        variants = [column]
        calm = [p for p in column if not p[3]]
        if len(calm) < len(column) and calm:
            variants.append(calm)
        for col in variants:
            kept: list[tuple[str, int, int, int]] = []
            if spans:
                ids, piece = [], []
                for word in _stream(text, col, lines, offsets):
                    v = cache.get(word[0])
                    if v is None:
                        v = cache[word[0]] = auto.lookup(word[0])
                    if v != -2:
                        ids.append(v)
                        piece.append(word[1])
                        kept.append(word)
            else:
                ids, piece = _numbers(auto, cache, col, lines)
            short, runs, deep = _runs(auto, ids)
            for item in short:
                n = auto.size[item]
                entry = found.setdefault(item, [0, set(), []])
                entry[0] = max(entry[0], n)
                entry[1].update(range(n))
                if spans:
                    for i in range(n - 1, len(ids)):
                        s = 0
                        for w in ids[i - n + 1 : i + 1]:
                            s = auto.next[s].get(w) if s is not None and w >= 0 else None
                            if s is None:
                                break
                        if s is not None and (item, n - 1) in auto.ends[s]:
                            entry[2].append((kept[i - n + 1][2], kept[i][3]))
            for item, end, last, n in _passages(auto, deep):
                entry = found.setdefault(item, [0, set(), []])
                entry[0] = max(entry[0], n)
                entry[1].update(range(end - n + 1, end + 1))
                if spans:
                    entry[2].append((kept[last - n + 1][2], kept[last][3]))
            pieces: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
            for item, part in _continued(auto, ids, piece, runs) if len(runs) > 1 else ():
                pieces[item].append(part)
            for item, ps in pieces.items():
                if len(ps) < 2:
                    continue
                ps.sort()
                for x, a in enumerate(ps):
                    total, tail = a[1] - a[0] + 1, a
                    chain = [a]
                    for b in ps[x + 1 :]:
                        # whole lines between them, and the item goes on where it stopped (a word may be lost in a break)
                        gap = b[0] - tail[1] - 1
                        skipped = piece[b[0]] - piece[tail[1]]
                        if gap > 0 and 0 < b[2] - tail[3] <= 2 and 1 <= skipped <= GAP_LINES + 1:
                            total += b[3] - tail[3]
                            tail = b
                            chain.append(b)
                    if len(chain) > 1 and total >= min(LEAST, auto.size[item]):
                        entry = found.setdefault(item, [0, set(), []])
                        entry[0] = max(entry[0], total)
                        for c in chain:
                            entry[1].update(range(c[2], c[3] + 1))
                            if spans:
                                entry[2].append((kept[c[0]][2], kept[c[1]][3]))
    return {item: (e[0], len(e[1]), e[2]) for item, e in found.items()}


def _pages(b: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[int, int, int] | None] | None]]:
    """(doc_id, text, boxes) of the pages with a text."""
    col = b.column("line_boxes")
    flat = col.flatten()
    edges = list(zip(*(flat.field(c).to_pylist() for c in ("x0", "x1", "y0"))))
    if flat.null_count:
        edges = [e if ok else None for e, ok in zip(edges, flat.is_valid().to_pylist())]
    count = pc.list_value_length(col).to_pylist()
    at = 0
    for doc, text, n in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), count):
        boxes = edges[at : at + n] if n is not None else None
        at += n or 0
        if text:
            yield doc, text, boxes


def _find(it: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    auto = shared.value
    cache: dict[str, int] = {}
    for b in it:
        out: list[tuple] = []
        for doc, text, boxes in _pages(b):
            if len(cache) > 500_000:
                cache.clear()
            for item, (longest, met, _) in leaks_of(auto, cache, text, boxes, False).items():
                out.append((doc, item, longest, met / auto.size[item]))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["doc_id", "item_id", "longest", "coverage"])


def automaton(items: DataFrame):
    """items (item_id, text): the given evaluation items, as a broadcast automaton. Items without words and null ids are
    left out. They have to be a small table: above ``MOST_CHARACTERS`` this raises instead of filling the driver."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_CHARACTERS:
        raise ValueError(f"evaluation items of {size} characters; divide them into sets of at most {MOST_CHARACTERS}")
    return items.sparkSession.sparkContext.broadcast(Automaton([(r[0], r[1]) for r in rows.orderBy("item_id").collect()]))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest, coverage): documents (doc_id, text, line_boxes) that hold LEAST consecutive words of
    an item within a column, or all of a shorter one. Null and empty texts hold nothing; missing boxes mean one column."""
    shared = automaton(items)
    return docs.select("doc_id", "text", "line_boxes").mapInArrow(partial(_find, shared=shared), "doc_id long, item_id long, longest int, coverage double")


def _clean(it: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    auto = shared.value
    cache: dict[str, int] = {}
    for b in it:
        out: list[tuple] = []
        for doc, text, boxes in _pages(b):
            hits = leaks_of(auto, cache, text, boxes, False)
            if not hits:
                continue
            hits = leaks_of(auto, cache, text, boxes, True)
            marks = bytearray(len(text))
            lines, offsets, at = text.split("\n"), [], 0
            for ln in lines:
                offsets.append(at)
                at += len(ln) + 1
            owner = {}
            for c, column in enumerate(columns(text, boxes)):
                for no, s, e, _ in column:
                    owner[offsets[no] + s, offsets[no] + e] = c
            for _, _, ss in hits.values():
                for s, e in ss:
                    c = next((c for (p, q), c in owner.items() if p <= s < q), None)
                    for (p, q), o in owner.items():
                        if o == c and p < e and q > s:
                            lo, hi = max(p, s), min(q, e)
                            marks[lo:hi] = b"\1" * (hi - lo)
            out.append((doc, sorted(hits), sum(marks), "".join(ch for ch, m in zip(text, marks) if not m)))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string()))], names=["doc_id", "item_ids", "n_removed", "text"])


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_ids, n_removed, text) of the documents with leaks: their text without the leaked passages."""
    shared = automaton(items)
    return docs.select("doc_id", "text", "line_boxes").mapInArrow(partial(_clean, shared=shared), "doc_id long, item_ids array<long>, n_removed long, text string")
