"""Text that was decoded with the wrong encoding: code-page swaps as substitution ciphers, told by language bigrams.

A swap replaces each character outside ASCII by one or more others, the same everywhere in a line. Passes:
1. Character bigrams outside ASCII per language, over all documents.
2. Suspects: lines (and whole pages) that some cipher reads better than they stand.
3. Expectation-maximization over the suspects. E: the posterior of every cipher, and of "not garbled", for each line,
   from the bigrams and the weights of the line's source. M: new weights per source; a letter table per source for
   swaps that follow no known page (symbol to letter, learned from the contexts alone); and the bigrams themselves,
   from which garbled lines are taken and to which their restored text is added. Then suspects are sought once more.
A line is garbled if the posterior of the ciphers together exceeds one half. Public code pages are only where the
ciphers start from. Replacement and control characters are garbled in any case.
"""

from __future__ import annotations

import atexit
import codecs
import math
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import drop, pin

PAGES = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852", "cp1251", "koi8_r", "cp866", "cp1253", "cp1254", "cp1257", "iso8859_15")
ROUNDS = 3  # rounds of expectation-maximization for each set of bigrams; 0 leaves the weights as they start
PRIOR = 0.01  # share of garbled lines before anything is learned
RARE = 1e-6  # least weight of a cipher
UNSEEN = 1e-8  # probability of a symbol where no text has it
SMALL = 20_000  # characters added to the size of every language, so that a handful of pages sets no standard
ONCE = 0.9  # taken from every count: what a line has once is no evidence for it
CAPITAL = 3.0  # log penalty of a capital that is judged by its small letter
FOREIGN = math.log(0.03)  # log share of symbols outside ASCII in a text of some other language,
FOREIGN_LETTER = math.log(500)  # among how many letters,
BESIDE = 3.0  # and beside how many others
MIXED = 6.0  # log penalty of what can hardly stand inside a word
JOINERS = "’‘´–—‐‑­¬·"
ODD = 1.0  # log likelihood by which the runs of a page have to fall behind the usual for a table of its own, each,
EVIDENCE = 12.0  # and by how much more all together
LEARNED = "learned"
MOST_PAIRS = 4_000_000  # bigrams that travel to the tasks in memory; the rarer ones travel as a sorted file
MOST_FACTS = 100_000  # runs of which the outcome travels with them
#: Digits that a scan may show for a letter.
MISREAD = {"1": "lL", "0": "oO", "5": "sS", "8": "bB"}
TYPES = re.compile(r"([\x00-\x7f])([^\x00-\x7f]+)(?=([\x00-\x7f]))")
RUN = re.compile(r"[^\x00-\x7f]+")
HOPELESS = re.compile("[\x80-\x84\x86-\x9f�]")
QUOTES = "—’“”„«»"
WHOLE, REST = -1, -2  # line numbers of suspects that are whole pages: for one cipher; for a letter table of its own
Type = tuple[str, str, str]


def _kind(ch: str) -> str:
    return "0" if ch.isdigit() else ch


def _class(ch: str) -> str:
    return "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch if ch <= "\x7f" else "*"


def _mixed(p: str, run: str, n: str) -> bool:
    """Whether a run can hardly stand in a word: marks between two letters, or letters of another script beside one."""
    if not (p.isalpha() or n.isalpha()):
        return False
    within = p.isalpha() and n.isalpha()
    return any(not _latin(ch) and (ch.isalpha() or (within and ch not in JOINERS)) for ch in run)


@lru_cache(maxsize=100_000)
def _latin(ch: str) -> bool:
    return unicodedata.name(ch, "").startswith("LATIN")


def _types(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, character before, run outside ASCII, character after); with an empty run, the characters of
    a language (``n`` = c) and the lines outside ASCII of a source (``n`` = l)."""
    for b in it:
        got: Counter = Counter()
        seen: dict[str, Counter] = {}
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist()):
            if not text:
                continue
            got[lang, "", "", "c"] += len(text)
            if not text.isascii():
                seen.setdefault(lang, Counter()).update(TYPES.findall(f"\n{text}\n"))
                got[source, "", "", "l"] += sum(not ln.isascii() for ln in text.split("\n"))
        for lang, types in seen.items():
            for (p, r, n), c in types.items():
                got[lang, p, r, n] += c
        yield _counted(got)


def _counted(got: Counter) -> pa.RecordBatch:
    rows = list(zip(*[(*k, v) for k, v in got.items()])) or [(), (), (), (), ()]
    return pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.string()) for c in rows[:4]), pa.array(list(rows[4]), pa.int64())], names=["lang", "p", "run", "n", "c"])


COUNTED = "lang string, p string, run string, n string, c long"


class Rare:
    """Counts of the bigrams that are not held in memory: keys and counts in files that every machine has, in the order
    of the keys. sums: (language, 'l' class before and symbol, 'r' symbol and class after, 'a' symbol; what it is; count)."""

    def __init__(self, langs: dict[str, int], name: str, sums: list[tuple[str, str, str, float]]):
        self.langs, self.name, self.sums = langs, name, sums
        self.files: tuple[np.ndarray, np.ndarray] | None = None

    def count(self, lang: str, ab: str) -> float:
        if self.files is None:  # mapped, not read
            self.files = tuple(np.asarray(np.memmap(SparkFiles.get(f"{self.name}.{x}"), np.int64, "r")) for x in "kc")  # type: ignore[assignment]
        keys, counts = self.files  # type: ignore[misc]
        key = np.int64(_pair_key(self.langs[lang], ab))
        at = int(np.searchsorted(keys, key))
        return int(counts[at]) - ONCE if at < len(keys) and keys[at] == key else 0

    def __getstate__(self) -> dict:
        return {**self.__dict__, "files": None, "sums": []}  # the sums are in the model


class Two(dict):
    """Counts of the bigrams of a language, those of ``rare`` included."""

    def __init__(self, lang: str, rare: Rare):
        super().__init__()
        self.lang, self.rare = lang, rare

    def __reduce__(self):
        return _two, (self.lang, self.rare, dict(self))

    def get(self, ab: str, default: float = 0) -> float:
        got = super().get(ab)
        return (self.rare.count(self.lang, ab) or default) if got is None and ab[0] > "\x7f" else default if got is None else got


def _two(lang: str, rare: Rare, held: dict) -> Two:
    two = Two(lang, rare)
    two.update(held)
    return two


def _pair_key(lang: int, ab: str) -> int:
    return lang << 42 | ord(ab[0]) << 21 | ord(ab[1])


class Bigrams:
    """Bigram likelihoods of characters outside ASCII; a symbol is as likely as the language in which it is most likely.
    Texts without language count as one more language."""

    def __init__(self, pairs: dict[tuple[str, str], int], sizes: dict[str, int], rare: Rare | None = None):
        self.size = {g: n + SMALL for g, n in sizes.items()}
        self.two: dict = {g: Two(g, rare) if rare else {} for g in self.size}
        self.left: dict = {g: {} for g in self.size}
        self.right: dict = {g: {} for g in self.size}
        self.all: dict = {g: {} for g in self.size}
        for (g, ab), c in pairs.items():
            if c <= 0 or g not in self.size:
                continue
            a, b = ab
            c -= ONCE
            self.two[g][ab] = c
            if b > "\x7f":
                k = _class(a) + b
                self.left[g][k] = self.left[g].get(k, 0) + c
            if a > "\x7f":
                k = a + _class(b)
                self.right[g][k] = self.right[g].get(k, 0) + c
                self.all[g][a] = self.all[g].get(a, 0) + c
        for g, kind, key, c in rare.sums if rare else ():
            of = {"l": self.left, "r": self.right, "a": self.all}[kind][g]
            of[key] = of.get(key, 0) + c
        self.alphabet = sorted({a for d in self.all.values() for a in d})
        self.letters = [a for a in self.alphabet if a.isalpha() or a in QUOTES]
        self.known = set(self.alphabet)
        self.after: dict[str, set[str]] = {}  # letters seen after a character
        for two in self.two.values():
            for ab in two:
                if ab[0] <= "\x7f" and (ab[1].isalpha() or ab[1] in QUOTES):
                    self.after.setdefault(ab[0], set()).add(ab[1])
        self.spread = math.log(max(64, len(self.alphabet)))
        self.memo: dict = {}
        self.best: dict = {}
        self.gains: dict[Type, np.ndarray] = {}  # Python workers are reused, so the model's caches outlive a task
        self.facts: dict[Type, tuple[float, bool]] = {}
        self.ones: dict[tuple[Type, int], float] = {}
        self.sparse: dict[Type, tuple[np.ndarray, np.ndarray]] = {}  # gains that came with the model

    def score(self, p: str, run: str, n: str) -> float:
        key = p, run, n
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            near = lambda ch: {_kind(ch), *MISREAD.get(ch, ())}
            got = max(self._score(a, run, b) for a in near(p) for b in near(n))
            small = run.lower()
            if small != run and len(small) == len(run):  # capitals are rare: what small letters do counts for them too
                got = max(got, max(self._score(a.lower(), small, b.lower()) for a in near(p) for b in near(n)) - CAPITAL)
            if _mixed(p, run, n):
                got -= MIXED
            self.memo[key] = got
        return got

    def _score(self, p: str, run: str, n: str) -> float:
        best = -1e9
        t = p + run + n
        wide = {"a": 26, "A": 26, "0": 1}
        c0 = _class(p)
        for g, size in self.size.items():
            two, left, right, every = self.two[g], self.left[g], self.right[g], self.all[g]
            v = math.log((0.8 * two.get(t[:2], 0) + 0.2 * left.get(c0 + t[1], 0) / wide.get(c0, 1) + 0.02) / size + UNSEEN)
            for a, b in zip(t[1:], t[2:]):
                c = _class(b)
                v += math.log((0.8 * two.get(a + b, 0) + 0.2 * right.get(a + c, 0) / wide.get(c, 1) + 0.02) / (every.get(a, 0) + 1))
            best = max(best, v)
        return best

    def letter(self, p: str, n: str) -> float:
        """The log likelihood of the likeliest letter between p and n."""
        got = self.best.get((p, n))
        if got is None:
            got = self.best[p, n] = max((self.score(p, x, n) for x in self.after.get(_kind(p), ())), default=-40.0)
        return got

    def stands(self, t: Type) -> float:
        """The log likelihood of a run as it stands: in one of the languages, or by chance in some other."""
        return max(self.score(*t), FOREIGN - BESIDE - (FOREIGN_LETTER + BESIDE) * len(t[1]) - MIXED * _mixed(*t))


def counts(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int], dict[str, int]]:
    """docs: lang, source, text. (runs in their places: p, run, n, c; bigrams: lang, ab, c; characters per language;
    lines outside ASCII per source), over all documents. The driver gets one row per language and one per source."""
    name = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    t = docs.select(name("lang").alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").mapInArrow(_types, COUNTED)
    t = pin(t.groupBy("lang", "p", "run", "n").agg(F.sum("c").alias("c")))
    sizes: dict[str, dict[str, int]] = {"c": {}, "l": {}}
    for r in t.where("run = ''").select("lang", "n", "c").collect():
        sizes[r[1]][r[0]] = r[2]
    return t.where("run <> ''").groupBy("p", "run", "n").agg(F.sum("c").alias("c")), pin(_bigrams(t.where("run <> ''"))), sizes["c"], sizes["l"]


def held(pairs: DataFrame, sizes: dict[str, int]) -> tuple[dict[tuple[str, str], int], Rare | None]:
    """Bigrams in memory and, if there are more than ``MOST_PAIRS``, the rarer ones as a file. Those after an ASCII
    character, at most 128 times the alphabet of a language, are always in memory."""
    n, least = pairs.count(), 0
    while n > MOST_PAIRS:
        least = 2 * least + 1
        n = pairs.where(F.col("c") > least).count()
    if not least:
        return {(r[0], r[1]): r[2] for r in pairs.collect()}, None
    kept = (F.col("c") > least) | (F.ascii("ab") <= 0x7F)
    got = {(r[0], r[1]): r[2] for r in pairs.where(kept).collect()}
    return got, _rare(pairs.where(~kept & (F.col("c") > 0)), sizes)


def _rare(rest: DataFrame, sizes: dict[str, int]) -> Rare:
    sc = rest.sparkSession.sparkContext
    langs = {g: k for k, g in enumerate(sorted(sizes))}
    sums = rest.mapInArrow(_rest_sums, "lang string, kind string, key string, c long, n long").groupBy("lang", "kind", "key")
    # at most one row per language, symbol and class of a neighbour
    sums = [(r[0], r[1], r[2], r[3] - ONCE * r[4]) for r in sums.agg(F.sum("c"), F.sum("n")).collect()]
    keyed = rest.mapInArrow(partial(_keyed, langs=langs), "key long, c long").orderBy("key").mapInArrow(_packed, "k binary, c binary")
    folder, name = tempfile.mkdtemp(prefix="vecloom-"), f"bigrams-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)  # executors fetch it when they start a task
    with open(f"{folder}/{name}.k", "wb") as keys, open(f"{folder}/{name}.c", "wb") as values:
        for r in keyed.toLocalIterator():  # one row per batch of pairs
            keys.write(r[0]), values.write(r[1])
    for x in "kc":
        sc.addFile(f"{folder}/{name}.{x}")
    return Rare(langs, name, sums)


def _rest_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        got: dict[tuple[str, str, str], list[int]] = {}
        for g, ab, c in zip(*(b.column(x).to_pylist() for x in ("lang", "ab", "c"))):
            keys = [("r", ab[0] + _class(ab[1])), ("a", ab[0])] + ([("l", _class(ab[0]) + ab[1])] if ab[1] > "\x7f" else [])
            for kind, key in keys:
                z = got.setdefault((g, kind, key), [0, 0])
                z[0] += c
                z[1] += 1
        cols = list(zip(*[(*k, *z) for k, z in got.items()])) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["lang", "kind", "key", "c", "n"])


def _keyed(it: Iterator[pa.RecordBatch], langs: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for b in it:
        keys = [_pair_key(langs[g], ab) for g, ab in zip(b.column("lang").to_pylist(), b.column("ab").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column("c")], names=["key", "c"])


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(x).to_numpy().astype(np.int64).tobytes()], pa.binary()) for x in ("key", "c")], names=["k", "c"])


def _facts(it: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in it:
        cols = [b.column(c) for c in ("p", "run", "n")]
        stands, odd, cipher, gain = [], [], [], []
        for t in zip(*(c.to_pylist() for c in cols)):
            s, o = CIPHERS.facts(t, model)
            g = CIPHERS.gain(t, model)
            k = np.flatnonzero(g > -np.inf) if o else np.empty(0, int)
            stands.append(s), odd.append(o), cipher.append(k.astype(np.int16)), gain.append(g[k].astype(np.float32))
        kinds = (pa.float64(), pa.bool_(), pa.list_(pa.int16()), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, k) for v, k in zip((stands, odd, cipher, gain), kinds))], names=["p", "run", "n", "stands", "odd", "cipher", "gain"])


def _shared(model: Bigrams, types: DataFrame):
    """The model as a broadcast variable, with what is known of the ``MOST_FACTS`` commonest runs; tasks work out the others."""
    sc = types.sparkSession.sparkContext
    bare = sc.broadcast(model)
    common = types.orderBy(F.desc("c"), "p", "run", "n").limit(MOST_FACTS).repartition(sc.defaultParallelism)
    facts = common.mapInArrow(partial(_facts, shared=bare), "p string, run string, n string, stands double, odd boolean, cipher array<short>, gain array<float>")
    for b in facts.toArrow().to_batches():
        c = {n: b.column(n).to_pylist() for n in ("p", "run", "n", "stands", "odd")}
        at, k, g = b.column("cipher").offsets.to_numpy(), b.column("cipher").flatten().to_numpy(), b.column("gain").flatten().to_numpy()
        off = int(at[0]) if len(at) else 0
        for i, t in enumerate(zip(c["p"], c["run"], c["n"])):
            model.facts[t] = c["stands"][i], c["odd"][i]
            if c["odd"][i]:
                model.sparse[t] = k[at[i] - off : at[i + 1] - off].copy(), g[at[i] - off : at[i + 1] - off].copy()
    bare.unpersist()
    return sc.broadcast(model)


def _bigrams(types: DataFrame) -> DataFrame:
    whole = F.translate(F.concat("p", "run", "n"), "123456789", "000000000")  # as in ``_kind``
    pairs = types.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.length(whole) - 1), lambda i: F.substr(whole, i, F.lit(2)))).alias("ab"), "c")
    return pairs.groupBy("lang", "ab").agg(F.sum("c").alias("c"))


def _page(name: str) -> tuple[list[str], dict[str, int]]:
    to = []
    for b in range(256):
        try:
            to.append(codecs.decode(bytes([b]), name))
        except UnicodeDecodeError:  # what a page leaves undefined is read as a control character
            to.append(chr(b))
    return to, {ch: b for b, ch in reversed(list(enumerate(to)))}


class Ciphers:
    """What a run of symbols was before, under each cipher that can have made it. Names: 'utf_8<cp1252' and the like."""

    def __init__(self) -> None:
        self.pages = {n: _page(n) for n in PAGES}
        self.memo: dict[str, dict[str, str]] = {}

    def _bytes(self, run: str, page: str) -> bytes | None:
        back = self.pages[page][1]
        try:
            return bytes([back[ch] for ch in run])
        except KeyError:
            return None

    def before(self, run: str) -> dict[str, str]:
        got = self.memo.get(run)
        if got is not None:
            return got
        got = {}
        for read in PAGES:
            raw = self._bytes(run, read)
            if raw is None:
                continue
            for page in PAGES:
                if page != read:
                    got[f"{page}<{read}"] = "".join(self.pages[page][0][b] for b in raw)
            try:
                x = raw.decode("utf-8")
            except UnicodeDecodeError:
                continue
            got[f"utf_8<{read}"] = x
            for again in PAGES:  # twice
                raw2 = self._bytes(x, again)
                try:
                    y = raw2.decode("utf-8") if raw2 else None
                except UnicodeDecodeError:
                    continue
                if y and y != x:
                    got[f"utf_8<{again}<utf_8<{read}"] = y
        if len(self.memo) < 200_000:
            self.memo[run] = got
        return got

    def gain(self, t: Type, model: Bigrams) -> np.ndarray:
        """Log ratio of each cipher (by number) for a run in its place, minus infinity where it cannot have made the run
        or gives back symbols that no text has."""
        got = model.gains.get(t)
        if got is None:
            got = np.full(len(NAMES), -np.inf)
            if t in model.sparse:
                k, g = model.sparse[t]
                got[k] = g
                model.gains[t] = got
                return got
            own, of = model.score(*t), {}
            for k, x in self.before(t[1]).items():
                v = of.get(x)
                if v is None:
                    v = of[x] = model.score(t[0], x, t[2]) - own if all(ch in model.known or ch <= "\x7f" for ch in x) else -math.inf
                got[NUMBER[k]] = v
            if len(model.gains) < 50_000:
                model.gains[t] = got
        return got

    def one(self, t: Type, k: int, model: Bigrams) -> float:
        """Log ratio of one cipher for a run in its place."""
        got = model.ones.get((t, k))
        if got is None:
            x = self.before(t[1]).get(NAMES[k])
            got = -math.inf if x is None or any(ch > "\x7f" and ch not in model.known for ch in x) else model.score(t[0], x, t[2]) - model.score(*t)
            if len(model.ones) < 500_000:
                model.ones[t, k] = got
        return got

    def facts(self, t: Type, model: Bigrams) -> tuple[float, bool]:
        """(log likelihood of a run as it stands, whether some cipher reads it better)."""
        got = model.facts.get(t)
        if got is None:
            got = model.stands(t), bool(self.gain(t, model).max() > 0)
            if len(model.facts) < 500_000:
                model.facts[t] = got
        return got


NAMES = [f"{x}<{r}" for r in PAGES for x in PAGES if x != r] + [f"utf_8<{r}" for r in PAGES] + [f"utf_8<{a}<utf_8<{r}" for r in PAGES for a in PAGES]
NUMBER = {k: n for n, k in enumerate(NAMES)}
CIPHERS = Ciphers()  # of a Python worker


def _together(types: list[Type], model: Bigrams, odd: set[Type]) -> dict[int, float]:
    """Log ratio of the ciphers (by number) that read all runs of a text better than they stand. Only runs in ``odd``
    can speak for a cipher, so the others are asked only about those."""
    out = [t for t in types if t in odd]
    if not out:
        return {}
    g = np.add.reduce([CIPHERS.gain(t, model) for t in out])
    sums = {int(k): float(g[k]) for k in np.flatnonzero(g > 0)}
    for t in types:
        if not sums:
            break
        if t not in odd:
            sums = {k: v for k, z in sums.items() if (v := z + CIPHERS.one(t, k, model)) > 0}
    return sums


def _suspects(it: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Lines that some cipher reads better than they stand or that hold a replacement or control character; and whole
    pages, given as the runs with their neighbours: those that one cipher reads better (line_no WHOLE), and what is left
    of those that some letter table might read better (REST)."""
    model = shared.value
    known = model.facts.get
    for b in it:
        out: list[tuple] = []
        cols = (b.column(c).to_pylist() for c in ("doc_id", "lang", "source", "text"))
        for doc, lang, source, text in zip(*cols):
            if not text or text.isascii():
                continue
            rest = TYPES.findall(f"\n{text}\n")
            lost_page = HOPELESS.search(text)
            facts = [known(t) or CIPHERS.facts(t, model) for t in rest]
            odd = {t for t, f in zip(rest, facts) if f[1]}
            behind = (model.usual - ODD) * len(rest) - sum(f[0] for f in facts)
            if odd and _together(rest, model, odd):
                out.append((doc, lang, source, WHOLE, _pieces(rest), False))
            gone: Counter = Counter()
            for no, line in enumerate(text.split("\n") if odd or lost_page else ()):
                if line.isascii():
                    continue
                lost = bool(lost_page and HOPELESS.search(line))
                here = TYPES.findall(f"\n{line}\n") if lost or odd else []
                suspect = bool(_together(here, model, odd))
                if lost or suspect:
                    out.append((doc, lang, source, no, line, lost))
                    gone.update(here)
            if gone:
                rest = [t for t in rest if not gone[t] or gone.subtract((t,))]
                behind = sum(model.usual - ODD - CIPHERS.facts(t, model)[0] for t in rest)
            if behind > EVIDENCE:
                out.append((doc, lang, source, REST, _pieces(rest), False))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "lang", "source", "line_no", "line", "lost"])


def _pieces(types: list[Type]) -> str:
    return "".join(p + r + n for p, r, n in types)


SUSPECTS = "doc_id long, lang string, source string, line_no int, line string, lost boolean"
Tables = dict[str, dict[str, dict[str, float]]]  # source: symbols: letter: log probability of the symbols given the letter


class Weights:
    """Log weight of a cipher in a source: half from the source's own lines, half from all sources."""

    def __init__(self, lines: dict[str, int], found: dict[tuple[str, str], float] | None):
        self.lines, self.found = lines, found
        self.memo: dict[tuple[str, str], float] = {}
        self.every: dict[str, float] = {}
        for (_, k), n in (found or {}).items():
            self.every[k] = self.every.get(k, 0.0) + n
        self.total = max(1, sum(lines.values()))

    def log(self, source: str, cipher: str) -> float:
        got = self.memo.get((source, cipher))
        if got is None:
            got = self.memo[source, cipher] = self._log(source, cipher)
        return got

    def _log(self, source: str, cipher: str) -> float:
        if self.found is None:  # the pages named first are the commonest
            return math.log(PRIOR / math.prod(2 + PAGES.index(p) for p in set(cipher.split("<")) if p in PAGES))
        share = self.found.get((source, cipher), 0.0) / max(1, self.lines.get(source, 1))
        return math.log(min(0.5, max(RARE, (share + self.every.get(cipher, 0.0) / self.total) / 2)))


def _table_gain(types: list[Type], table: dict[str, dict[str, float]], model: Bigrams) -> float:
    """Log ratio of a learned letter table for a text; symbols it has not met count as any letter at random."""
    total = 0.0
    for t in types:
        of = table.get(t[1])
        if of:
            v = max(model.score(t[0], x, t[2]) + w for x, w in of.items())
        else:
            v = model.letter(t[0], t[2]) - model.spread * len(t[1])
        total += v - model.stands(t)
    return total


def _line_odds(line: str, no: int, source: str, model: Bigrams, weights: Weights, tables: Tables) -> dict[str, tuple[float, float]]:
    """cipher: (log odds against the line as it stands, log ratio) of the ciphers that can have made the line."""
    types = TYPES.findall(line if no < 0 else f"\n{line}\n")
    out = {}
    if no != REST:
        odd = {t for t in types if CIPHERS.facts(t, model)[1]}
        out = {NAMES[k]: (g + weights.log(source, NAMES[k]), g) for k, g in _together(types, model, odd).items()}
    if no != WHOLE and source in tables and types:
        g = _table_gain(types, tables[source], model)
        if g > 0:
            out[LEARNED] = (g + weights.log(source, LEARNED), g)
    return out


def _garbled(odds: dict[str, tuple[float, float]]) -> float:
    """Posterior that one of the ciphers made the line."""
    if not odds:
        return 0.0
    top = max(v for v, _ in odds.values())
    z = top + math.log(sum(math.exp(v - top) for v, _ in odds.values()))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _expect(it: Iterator[pa.RecordBatch], shared, weights: Weights, tables: Tables) -> Iterator[pa.RecordBatch]:
    """Expected lines per source and cipher."""
    model = shared.value
    for b in it:
        got: Counter = Counter()
        for source, no, line in zip(b.column("source").to_pylist(), b.column("line_no").to_pylist(), b.column("line").to_pylist()):
            if no == WHOLE:
                continue
            odds = _line_odds(line, no, source, model, weights, tables)
            all_ = _garbled(odds)
            if all_ > 1e-6:
                top = max(v for v, _ in odds.values())
                z = sum(math.exp(v - top) for v, _ in odds.values())
                for k, (v, _) in odds.items():
                    got[source, k] += all_ * math.exp(v - top) / z
        rows = list(zip(*[(*k, v) for k, v in got.items()])) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(rows[0]), pa.string()), pa.array(list(rows[1]), pa.string()), pa.array(list(rows[2]), pa.float64())], names=["source", "cipher", "s"])


def _decide(it: Iterator[pa.RecordBatch], shared, weights: Weights, tables: Tables) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in it:
        out: list[tuple] = []
        cols = (b.column(c).to_pylist() for c in ("doc_id", "lang", "source", "line_no", "line", "lost"))
        for doc, lang, source, no, line, lost in zip(*cols):
            odds = _line_odds(line, no, source, model, weights, tables)
            if _garbled(odds) > 0.5:
                k = min(odds, key=lambda c: (-round(odds[c][0], 6), c))
                out.append((doc, lang, source, no, line, lost, k, odds[k][1]))
            elif lost:
                out.append((doc, lang, source, no, line, True, None, None))
        cols = list(zip(*out)) or [()] * 8
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "lang", "source", "line_no", "line", "lost", "cipher", "gain"])


DECIDED = "doc_id long, lang string, source string, line_no int, line string, lost boolean, cipher string, gain double"


def _page_types(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        got: Counter = Counter()
        for source, line in zip(b.column("source").to_pylist(), b.column("line").to_pylist()):
            for t in TYPES.findall(line):
                got[source, *t] += 1
        yield _counted(got)


def _learn(t: pa.Table, shared) -> pa.Table:
    """The letter table of one source from the runs of its suspect pages: expectation-maximization over which letter
    each run stands for, starting from all letters alike.

    The table is kept only if it explains the pages better than they stand by more than it costs to state it, and if
    what it restores is as likely, symbol for symbol, as the language's own text.
    """
    model = shared.value
    none = pa.table({"source": pa.array([], pa.string()), "run": pa.array([], pa.string()), "letter": pa.array([], pa.string()), "w": pa.array([], pa.float64())})
    rows = [(p, r, n) for p, r, n in zip(t["p"].to_pylist(), t["run"].to_pylist(), t["n"].to_pylist())]
    count, letters = np.array(t["c"].to_pylist(), float), model.letters
    runs = sorted({r for _, r, _ in rows})
    if not rows or not letters:
        return none
    place = {r: k for k, r in enumerate(runs)}
    at = np.array([place[r] for _, r, _ in rows])
    beside = sorted({(p, n) for p, _, n in rows})  # likelihoods depend on the neighbours alone
    place = {b: k for k, b in enumerate(beside)}
    s = np.array([[model.score(p, x, n) for x in letters] for p, n in beside])[[place[p, n] for p, _, n in rows]]
    theta = np.full((len(runs), len(letters)), 1 / len(runs))
    for _ in range(20):
        post = np.exp(s - s.max(1, keepdims=True)) * theta[at]
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        theta = np.full((len(runs), len(letters)), 1e-3)
        np.add.at(theta, at, post * count[:, None])
        theta /= theta.sum(0, keepdims=True)
    post = np.zeros((len(runs), len(letters)))
    z = np.exp(s - s.max(1, keepdims=True)) * theta[at]
    np.add.at(post, at, z / np.maximum(z.sum(1, keepdims=True), 1e-300) * count[:, None])
    best = post.argmax(1)
    # what the table gains, run by run; runs that gain nothing are no part of it
    gain = np.zeros(len(runs))
    restored = s[np.arange(len(rows)), best[at]]
    stands = np.array([model.stands(r) for r in rows])
    emit = np.log(theta[np.arange(len(runs)), best])
    np.add.at(gain, at, count * (restored + emit[at] - stands))
    cost = model.spread + math.log(len(letters))
    use = gain > cost
    total = float((gain - cost)[use].sum())
    used = use[at]
    weight = count[used].sum()
    if total < EVIDENCE or weight < count.sum() / 2 or (count * restored)[used].sum() / weight < shared.value.usual - 1.0:
        return none
    k = np.flatnonzero(use)
    name = t["lang"][0].as_py()
    return pa.table({"source": pa.array([name] * len(k), pa.string()), "run": pa.array([runs[i] for i in k], pa.string()), "letter": pa.array([letters[best[i]] for i in k], pa.string()), "w": pa.array(emit[k])})


def _usual(model: Bigrams) -> float:
    """Mean log likelihood of a symbol outside ASCII where the languages have it."""
    n = total = 0.0
    for g, two in model.two.items():
        right = model.right[g]
        most: dict[str, str] = {}  # symbol: with the class that follows it most often
        for k, c in right.items():
            if k[0] not in most or c > right[most[k[0]]]:
                most[k[0]] = k
        for ab, c in two.items():
            if ab[1] > "\x7f" and ab[0] <= "\x7f":
                after = most.get(ab[1])
                total += c * (math.log(c / model.size[g]) + (math.log(model.right[g][after] / model.all[g][ab[1]] / (26 if after[1] in "aA" else 1)) if after else -3.0))
                n += c
    return total / n if n else -20.0


def _moved(it: Iterator[pa.RecordBatch], tables: Tables) -> Iterator[pa.RecordBatch]:
    """Counts to take from the bigrams (garbled lines) and to add to them (the same lines restored)."""
    for b in it:
        got: Counter = Counter()
        cols = (b.column(c).to_pylist() for c in ("lang", "source", "line", "cipher"))
        for lang, source, line, cipher in zip(*cols):
            for p, r, n in TYPES.findall(f"\n{line}\n"):
                got[lang, p, r, n] -= 1
                x = _before(r, cipher, source, tables)
                if x and RUN.fullmatch(x):
                    got[lang, p, x, n] += 1
        yield _counted(got)


def _before(run: str, cipher: str | None, source: str, tables: Tables) -> str | None:
    if cipher == LEARNED:
        of = tables.get(source, {}).get(run)
        return max(of, key=lambda x: (of[x], x)) if of else None
    return CIPHERS.before(run).get(cipher) if cipher else None


def garbled_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) to (doc_id, source, line_no, line, lost, cipher, gain, letters), one row per
    garbled line; a negative line_no means that the page as a whole was read wrong, though its lines one by one might pass.

    lost: it holds a replacement or control character. cipher: the most probable swap given the source's weights after
    expectation-maximization, null where none explains the line; "learned" is the source's own letter table, given in
    letters. Null, empty and pure ASCII texts are never garbled; null languages count as one more language; null
    sources share one set of weights.
    """
    spark = docs.sparkSession
    types, every, sizes, lines = counts(docs)
    types = pin(types)
    pairs, rare = held(every, sizes)
    d = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    d = d.select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    old = None
    for last in (False, True):
        model = Bigrams(pairs, sizes, rare)
        model.usual = _usual(model)
        shared = _shared(model, types)
        s = pin(d.mapInArrow(partial(_suspects, shared=shared), SUSPECTS))
        tables = _tables(s, shared) if ROUNDS else {}
        weights = Weights(lines, None)
        for _ in range(ROUNDS):
            e = s.mapInArrow(partial(_expect, shared=shared, weights=weights, tables=tables), "source string, cipher string, s double")
            e = e.groupBy("source", "cipher").agg(F.sum("s")).where("`sum(s)` > 0.01").collect()  # sources by ciphers, at most
            weights = Weights(lines, {(r[0], r[1]): r[2] for r in e})
        found = pin(s.mapInArrow(partial(_decide, shared=shared, weights=weights, tables=tables), DECIDED))
        drop(s), drop(old)
        old = found
        if last or not ROUNDS:
            break
        swapped = found.where(F.col("cipher").isNotNull())
        pages = swapped.where(F.col("line_no") == WHOLE).select(F.col("doc_id").alias("whole"))
        swapped = swapped.join(pages, (F.col("doc_id") == F.col("whole")) & (F.col("line_no") >= 0), "left_anti")  # pages hold their lines
        moved = swapped.select("lang", "source", "line", "cipher").mapInArrow(partial(_moved, tables=tables), COUNTED)
        moved = moved.groupBy("lang", "p", "run", "n").agg(F.sum("c").alias("c"))
        if rare:
            both = pin(every.unionByName(_bigrams(moved)).groupBy("lang", "ab").agg(F.sum("c").alias("c")))
            drop(every)
            every = both
            pairs, rare = held(every, sizes)
            continue
        for r in _bigrams(moved).collect():  # at most the bigrams of garbled lines, of which there are fewer than of all
            pairs[r[0], r[1]] = pairs.get((r[0], r[1]), 0) + r[2]
    drop(every)
    letters = [(s_, [(r, max(of, key=lambda x: (of[x], x))) for r, of in sorted(t.items())]) for s_, t in tables.items()]  # noqa: B023
    if letters:
        known = spark.createDataFrame(letters, "ls string, letters array<struct<run: string, letter: string>>")
        found = found.join(F.broadcast(known), F.col("source") == F.col("ls"), "left").drop("ls")  # one row per source with a table
    else:
        found = found.withColumn("letters", F.lit(None).cast("array<struct<run: string, letter: string>>"))
    return found.select("doc_id", "source", "line_no", "line", "lost", "cipher", "gain", "letters")


def _tables(suspects: DataFrame, shared) -> Tables:
    """Learned letter tables of the sources with pages that some table might explain."""
    pages = suspects.where(F.col("line_no") == REST).select("source", "line")
    types = pages.mapInArrow(_page_types, COUNTED).groupBy("lang", "p", "run", "n").agg(F.sum("c").alias("c"))
    got = types.groupBy("lang").applyInArrow(lambda t: _learn(t, shared), "source string, run string, letter string, w double")
    out: Tables = {}
    for r in got.collect():  # a row for each symbol of a source's table
        out.setdefault(r[0], {}).setdefault(r[1], {})[r[2]] = r[3]
    return out


def _restored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        texts, whole, many = [], [], []
        for text, lines in zip(b.column("text").to_pylist(), b.column("lines").to_pylist()):
            parts, ok = text.split("\n"), True
            table = {x["run"]: x["letter"] for z in lines for x in z["letters"] or ()}
            known = {x["line_no"]: x["cipher"] for x in lines if x["line_no"] >= 0}
            page = next((x["cipher"] for x in lines if x["line_no"] < 0), None)
            for no, old in enumerate(parts):
                if old.isascii() or (no not in known and not page):
                    continue
                cipher = known[no] or page if no in known else page
                if cipher is None:
                    ok = False
                    continue
                read = _letters(old, cipher, table)
                if no not in known and not all(read.values()) and cipher != LEARNED:
                    continue  # the page's cipher cannot have made this line
                parts[no] = _translate(old, {r: x or r for r, x in read.items()})
                ok = ok and not HOPELESS.search(parts[no])
            ok = ok and not any(x["cipher"] is None and not page for x in lines)
            _rest(parts, lines)
            texts.append("\n".join(parts))
            whole.append(ok)
            many.append(max(1, len(known)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(many, pa.int32()), pa.array(whole, pa.bool_()), pa.array(texts, pa.string())], names=["doc_id", "source", "n_lines", "recovered", "text"])


def _letters(line: str, cipher: str, table: dict[str, str]) -> dict[str, str | None]:
    runs = set(RUN.findall(line))
    if cipher == LEARNED:
        marks = set(QUOTES + JOINERS)
        by_symbol = lambda r: "".join(table.get(ch, ch) for ch in r) if any(ch in table for ch in r) and all(ch in table or ch in marks for ch in r) else None
        return {r: by_symbol(r) or table.get(r) for r in runs}
    return {r: CIPHERS.before(r).get(cipher) for r in runs}


def _translate(line: str, letters: dict[str, str]) -> str:
    if all(len(r) == 1 for r in letters):
        return line.translate(str.maketrans(letters))
    return RUN.sub(lambda m: letters[m.group()], line)


def _rest(parts: list[str], lines: list[dict]) -> None:
    """Lines too short to tell alone, where the page's cipher of several symbols a letter reads every run."""
    known = {x["line_no"] for x in lines}
    common = Counter(x["cipher"] for x in lines if x["cipher"] and x["cipher"].startswith("utf_8")).most_common(1)
    for no, old in enumerate(parts if common and min(known) >= 0 else []):
        if no in known or old.isascii():
            continue
        letters = _letters(old, common[0][0], {})
        if all(letters.values()):
            parts[no] = _translate(old, letters)  # type: ignore[arg-type]


def restore(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, source, n_lines, recovered, text) of the garbled documents: their lines translated back where possible."""
    per = lines.groupBy(F.col("doc_id").alias("ld")).agg(F.collect_list(F.struct("line_no", "cipher", "letters")).alias("lines"))
    j = docs.select("doc_id", "source", "text").join(per, F.col("doc_id") == F.col("ld")).select("doc_id", "source", "text", "lines")
    return j.mapInArrow(_restored, "doc_id long, source string, n_lines int, recovered boolean, text string")

