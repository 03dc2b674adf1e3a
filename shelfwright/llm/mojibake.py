"""Problem 5: text fields that were decoded with a wrong character encoding, with the original text where it can be had.

Method: smoothed character trigram models are trained on the clean values; every candidate chain (encode the garbled characters with one
encoding, decode the bytes with another) is scored by what it gains in likelihood around the characters it changes, and the likeliest is
accepted if its gain exceeds a margin. The margin is validated on held-out clean values, as they are and garbled by hash-chosen chains.
Chains are applied again until none is accepted, which undoes repeated wrong decodings. Bytes that were lost on the way are filled in by the
model; a replacement character marks a value as affected that can't be restored.

Scale: three maps over the scan (training, validation, scoring) without a shuffle of text; models are hashed count tables of fixed size,
added up over all values. Only values with characters beyond ASCII are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRI, BI, UNI = 1 << 20, 1 << 18, 1 << 16
HELD_OUT = 8  # one clean value in so many, by hash, is kept from training and validates the margin
TOUCHED = 1 / 500  # share of held-out clean values that may reach a margin
MARGINS = ((2.0, 8.0), (4.0, 12.0), (6.0, 14.0))  # bounds for chains over UTF-8, between one-byte encodings, and for lost bytes
#: Encodings that garbled characters may have been taken for, and pairs of one-byte encodings.
OVER_UTF8 = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
ONE_BYTE = (("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"))
CHAINS = tuple((b, "utf-8") for b in OVER_UTF8) + ONE_BYTE
LOST = "lost bytes"
#: What garbled text in Western languages is likely to have been; other scripts come up where clean neighbours happen to form a sequence.
_LIKELY = re.compile(r"[\x00-\x7f\xa0-\u024f\u02c6-\u02dc\u2010-\u203a\u20ac\u2122]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
_CONTROL = re.compile(r"[\x80-\x9f]")


def _table(encoding: str) -> dict[str, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b  # undefined there, so it stays a control character
    return out


_TO_BYTE = {e: _table(e) for e in {b for b, _ in CHAINS}}
_FROM_BYTE = {e: {b: c for c, b in t.items()} for e, t in ((e, _table(e)) for _, e in ONE_BYTE)}


def _utf8(data: list[int | None], run: str) -> tuple[str, int]:
    """The run with each complete UTF-8 sequence decoded and all else kept, and how many there were."""
    out, i, n = [], 0, 0
    while i < len(data):
        b = data[i]
        size = 0 if b is None else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        part = data[i : i + size]
        if size and len(part) == size and all(x is not None and x & 0xC0 == 0x80 for x in part[1:]):
            try:
                out.append(bytes(part).decode())
                i, n = i + size, n + 1
                continue
            except UnicodeDecodeError:
                pass
        out.append(run[i])
        i += 1
    return "".join(out), n


@lru_cache(maxsize=200_000)
def decodings(run: str) -> tuple[tuple[int, str], ...]:
    """(number of the chain, result) of the chains that change a run of characters beyond ASCII."""
    found = []
    for k, (b, a) in enumerate(CHAINS):
        table = _TO_BYTE[b]
        data = [table.get(c) for c in run]
        if a == "utf-8":
            text, n = _utf8(data, run)
            if not n and any(c.islower() for c in run):  # garbled, then put in lower case
                text, n = _utf8([table.get(c.upper() if "\xe0" <= c <= "\xf6" else c) for c in run], run)
                text = text.lower()
            if n:
                found.append((k, text))
        elif None not in data:
            text = "".join(_FROM_BYTE[a].get(x, "") for x in data)
            if len(text) == len(run) and text != run and not any("\x7f" <= c < "\xa0" for c in text):
                found.append((k, text))
    return tuple(found)


@lru_cache(maxsize=50_000)
def _completions(run: str, alphabet: str) -> tuple[str, ...]:
    """Readings of a run in which a character begins a UTF-8 sequence whose other bytes were lost."""
    out = []
    for b in ("cp1252", "latin-1"):
        data = [_TO_BYTE[b].get(c) for c in run]
        for i, x in enumerate(data):
            if x is None or not 0xC2 <= x < 0xF0:
                continue
            end = i + 1
            while end < len(data) and data[end] is not None and data[end] & 0xC0 == 0x80:
                end += 1
            begin = bytes(data[i:end])
            out += [run[:i] + c + run[end:] for c in alphabet if c.encode().startswith(begin) and len(c.encode()) > len(begin)]
    return tuple(dict.fromkeys(out))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram, bigram and single counts; each text begins and ends with two line breaks."""
    c = _codes("\n\n" + "\n\n".join(texts) + "\n\n")
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = (b * 40503 + d) % BI
    three = ((a * 40503 + b) * 40503 + d) % TRI
    return np.bincount(three, minlength=TRI), np.bincount(two, minlength=BI), np.bincount(c % UNI, minlength=UNI)


class Model:
    """Trigrams interpolated with bigrams and single characters."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray, uni: np.ndarray, alphabet: str) -> None:
        self.tri, self.bi, self.uni, self.n, self.alphabet = tri, bi, uni, float(uni.sum()) + UNI, alphabet
        self.cached = lru_cache(maxsize=500_000)(self._score)

    def _score(self, text: str) -> float:
        """Log-likelihood of a text from its third character on."""
        total = 0.0
        o = [ord(x) for x in text]
        for i in range(2, len(o)):
            a, b, d = o[i - 2], o[i - 1], o[i]
            p1 = (self.uni[d % UNI] + 1) / self.n
            p2 = (self.bi[(b * 40503 + d) % BI] + 4 * p1) / (self.uni[b % UNI] + 4)
            p3 = (self.tri[((a * 40503 + b) * 40503 + d) % TRI] + 4 * p2) / (self.bi[(a * 40503 + b) % BI] + 4)
            total += float(np.log(p3))
        return total

    def options(self, text: str) -> tuple[dict[object, float], dict[object, list[tuple[int, int, str, float]]]]:
        """For each chain what it gains over all runs of a text, and the changes it makes."""
        padded = "\n\n" + text + "\n\n"
        gains: dict[object, float] = {}
        changes: dict[object, list[tuple[int, int, str, float]]] = {}
        for m in _RUN.finditer(text):
            s, e = m.start() + 2, m.end() + 2
            before, after = padded[s - 2 : s], padded[e : e + 2]
            readings: list[tuple[object, str]] = list(decodings(m[0]))
            if any("\xc2" <= c <= "\xef" for c in m[0]):
                readings += [(LOST, c) for c in _completions(m[0], self.alphabet)]
            if not readings:
                continue
            own = self.cached(before + m[0] + after)
            for k, to in readings:
                # a chain that makes fewer characters of many must not gain by that alone
                g = self.cached(before + to + after) - own - 2.0 * (len(m[0]) - len(to))
                if g > 0:
                    known = changes.setdefault(k, [])
                    if known and known[-1][0] == m.start():
                        if g <= known[-1][3]:
                            continue
                        gains[k] -= known.pop()[3]
                    known.append((m.start(), m.end(), to, g))
                    gains[k] = gains.get(k, 0.0) + g
        return gains, changes

    def repair(self, text: str, margins: tuple[float, float, float]) -> tuple[list[str], str]:
        """The chains undone, in order, and the text after it. A one-byte chain ends the search: what it gives was never UTF-8 text."""
        done: list[str] = []
        while True:  # every chain makes the text shorter, or is the last one
            gains, changes = self.options(text)
            allowed = [k for k in gains if gains[k] > margins[kind_of(k)] and not (done and kind_of(k) == 1)]
            if not allowed:
                break
            # whole sequences are better evidence than any other
            k = min(allowed, key=lambda x: (kind_of(x) != 0, -gains[x], str(x)))
            out, at = [], 0
            for s, e, to, _ in changes[k]:
                out += [text[at:s], to]
                at = e
            text = "".join(out) + text[at:]
            done.append(k if k == LOST else f"{CHAINS[k][1]} read as {CHAINS[k][0]}")
            if kind_of(k):
                break
        return done, text


def kind_of(chain: object) -> int:
    """0 for chains that decode UTF-8, 1 for those between one-byte encodings, 2 for guessed bytes."""
    return 2 if chain == LOST else int(CHAINS[chain][1] != "utf-8")


def looks_clean(text: str) -> bool:
    """No replacement or control character and no run that holds a whole UTF-8 sequence in some one-byte encoding."""
    return "�" not in text and not _CONTROL.search(text) and not any(k < len(OVER_UTF8) and _LIKELY.fullmatch(to) for m in _RUN.finditer(text) for k, to in decodings(m[0]))


def _held_out(text: str) -> bool:
    return xxhash.xxh64_intdigest(text) % HELD_OUT == 0


def _garble(text: str) -> str:
    """A text put through a hash-chosen chain the wrong way; the text itself if it doesn't go through."""
    b, a = CHAINS[xxhash.xxh64_intdigest(text, 7) % len(CHAINS)]
    try:
        data = text.encode(a)
    except UnicodeEncodeError:
        return text
    back = {v: k for k, v in _TO_BYTE[b].items()}
    return "".join(chr(x) if x < 128 else back[x] for x in data)


def train(cells: DataFrame) -> Model:
    """The model over all clean values of cells(value) that aren't held out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n, dtype=np.int64) for n in (TRI, BI, UNI)]
        letters: dict[str, int] = {}
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t.isascii() or (looks_clean(t) and not _held_out(t))]
            if not texts:
                continue
            for s, c in zip(sums, counts_of(texts), strict=True):
                s += c
            for t in texts:
                if not t.isascii():
                    for c in set(t):
                        if c > "\x7f":
                            letters[c] = letters.get(c, 0) + 1
        for k, s in enumerate(sums):
            at = np.nonzero(s)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at), pa.array(s[at])], names=["k", "at", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([3] * len(letters), pa.int32()), pa.array([ord(c) for c in letters], pa.int64()), pa.array(list(letters.values()), pa.int64())], names=["k", "at", "n"])

    got = cells.select("value").mapInArrow(count, "k int, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()  # tables of fixed size
    sums = []
    for k, n in enumerate((TRI, BI, UNI)):
        part = got[got["k"] == k]
        s = np.zeros(n)
        s[part["at"].to_numpy(dtype=np.int64)] = part["n"].to_numpy(dtype=np.float64)
        sums.append(s.astype(np.float32))
    letters = got[(got["k"] == 3)].sort_values(["n", "at"], ascending=[False, True])["at"]
    return Model(*sums, "".join(chr(c) for c in letters))


def validated_margins(cells: DataFrame, model: Model) -> tuple[float, float, float]:
    """For each kind of chain the least gain that at most TOUCHED of the held-out clean values reach, between the bounds of MARGINS.

    The held-out values are also garbled by hash-chosen chains; a margin that would miss most of those of its kind is lowered to the median
    of what they gain, never below its bound.
    """
    tri, bi, uni, alphabet = model.tri, model.bi, model.uni, model.alphabet

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(tri, bi, uni, alphabet)
        hist = np.zeros((2, 3, 200), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not (looks_clean(t) and _held_out(t)):
                    continue
                for garbled, x in enumerate((t, _garble(t))):
                    if garbled and x == t:
                        continue
                    best = [0.0, 0.0, 0.0]
                    for k, g in m.options(x)[0].items():
                        best[kind_of(k)] = max(best[kind_of(k)], g)
                    for kind, g in enumerate(best):
                        hist[garbled, kind, min(199, int(g * 4))] += 1
        a, k, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (a, k, at)] + [pa.array(hist[a, k, at])], names=["a", "k", "at", "n"])

    got = cells.select("value").mapInArrow(score, "a int, k int, at int, n long").groupBy("a", "k", "at").agg(F.sum("n").alias("n")).toPandas()  # 1,200 rows at most
    hist = np.zeros((2, 3, 200))
    for a, k, at, n in got.itertuples(index=False):
        hist[a, k, at] = n
    out = []
    for kind, (least, most) in enumerate(MARGINS):
        above = hist[0, kind][::-1].cumsum()[::-1]  # clean values with at least this gain
        fit = np.nonzero(above <= hist[0, kind].sum() * TOUCHED)[0]
        margin = fit[0] / 4 if len(fit) and hist[0, kind].sum() else most
        gained = hist[1, kind][1:].cumsum()
        if gained[-1] and kind != 2:
            margin = min(margin, (np.searchsorted(gained, gained[-1] / 2) + 1) / 4)
        out.append(float(min(most, max(least, margin))))
    return out[0], out[1], out[2]


def repair_fields(listings: DataFrame, fields: tuple[str, ...] = ("ProductName", "ProductDescription"), row: str = "record_id") -> DataFrame:
    """(record_id, field_name, chains, restored, text): affected values with the chains that were undone, in order, and the text after it.

    restored tells whether the whole value could be restored: not where a replacement character is left or lost bytes had to be guessed.
    NULL and pure ASCII values are never affected; texts of any length are scored whole; repeated values come out alike; without listings
    there are no rows; further columns are not read.
    """
    cells = listings.select(F.col(row).alias("record_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("c")).select("record_id", "c.*")
    cells = cells.filter("value is not null")
    beyond = cells.filter(F.col("value").rlike(r"[^\x00-\x7F]"))
    model = train(cells)
    margins = validated_margins(beyond, model)
    tri, bi, uni, alphabet = model.tri, model.bi, model.uni, model.alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(tri, bi, uni, alphabet)
        for batch in batches:
            rows, chains, whole, texts = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                done, t = m.repair(t, margins)
                if done or "�" in t:
                    rows.append(i)
                    chains.append(done)
                    whole.append("�" not in t and LOST not in done)
                    texts.append(t)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(chains, pa.list_(pa.string())), pa.array(whole, pa.bool_()), pa.array(texts, pa.string())],
                names=["record_id", "field_name", "chains", "restored", "text"],
            )

    return beyond.select("record_id", "field_name", "value").mapInArrow(run, "record_id string, field_name string, chains array<string>, restored boolean, text string")
