"""Problem 10: texts over a token limit cut into pieces that end at natural places and share tokens with the next piece.

Method: agglomerative merging. A text is cut into atomic segments at every natural boundary (paragraph, line, sentence, clause; words only
within a segment that is itself too large). Adjacent pairs are held in a heap, and the weakest boundary is merged first for as long as
the combined size plus the overlap fits the limit, so the strongest boundaries are the ones that remain. Pieces end at these, and each
starts the overlap before the end of the one before it, so ends are natural and starts are where the count puts them.

Tokens are those of the public WordPunct tokenizer. The count runs in the JVM and decides which texts go to Python at all; the cutting is
a map over Arrow batches without a shuffle. One text is the unit of work.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.functions.text import wordpunct_count

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Boundaries by falling strength; each match ends where the next segment begins.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1, 0
_BREAK = re.compile(r"[.!?…。][\"')\]»”’]*\s+|[\r\n]\s*|</(?:p|div|ul|ol|h[1-6]|table|li)>(?:\s*<[^<>]*>)*\s*|<br ?/?>(?:\s*<[^<>]*>)*\s*")
_LINES = re.compile(r"\r\n|\r|\n")
_CLAUSE = re.compile(r"(?<=[,;:|•–—])\s+")


def _strength(found: str) -> int:
    if found[0] == "<":
        return LINE if found.startswith(("</li", "<br")) else PARAGRAPH
    lines = len(_LINES.findall(found)) if not found.endswith(" ") or "\n" in found or "\r" in found else 0
    return PARAGRAPH if lines > 1 else LINE if lines else SENTENCE


def _segments(text: str, most: int) -> list[tuple[int, int, int]]:
    """(start, tokens, strength of the boundary before it) of the atomic segments; none has over `most` tokens."""
    cuts = [(0, PARAGRAPH)]
    for m in _BREAK.finditer(text):
        if m.end() == len(text) or not text[m.end() - 1].isspace() and len(TOKEN.match(text, m.end() - 1)[0]) > 1:
            continue  # within a token
        cuts.append((m.end(), _strength(m[0])))
    out: list[tuple[int, int, int]] = []
    for i, (start, strength) in enumerate(cuts):
        end = cuts[i + 1][0] if i + 1 < len(cuts) else len(text)
        n = len(TOKEN.findall(text, start, end))
        if n == 0:
            continue  # white space belongs to the segment before it
        if n <= most:
            out.append((start, n, strength))
            continue
        inner = [start, *(m.end() for m in _CLAUSE.finditer(text, start, end) if m.end() < end), end]
        for j, (a, b) in enumerate(zip(inner, inner[1:], strict=False)):
            n = len(TOKEN.findall(text, a, b))
            if n <= most:
                if n:
                    out.append((a, n, strength if j == 0 else CLAUSE))
                continue
            spans = [m.start() for m in TOKEN.finditer(text, a, b)]
            out += [(a if k == 0 else s, 1, (strength if j == 0 else CLAUSE) if k == 0 else WORD) for k, s in enumerate(spans)]
    return out


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, own tokens) of the pieces of a text; own tokens are those that the piece before it doesn't share.

    Every piece ends at a chosen boundary, and the next one starts exactly `overlap` tokens before that end. No piece has more than `limit`
    tokens, and together the pieces cover every token. A text of no more than `limit` tokens is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    most = limit - overlap
    seg = _segments(text, most)
    n = len(seg)
    size = [s[1] for s in seg]
    if sum(size) <= limit:
        return [(0, len(text), sum(size), sum(size))]
    room = lambda j: most if j else limit  # noqa: E731  the first piece shares nothing with one before it, and so has over `overlap` tokens
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(seg[i][2], size[i - 1] + size[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, both, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = before[i]
        if size[j] + size[i] != both:  # a side has grown since; it is looked at again with its size now
            if size[j] + size[i] <= room(j):
                heapq.heappush(heap, (seg[i][2], size[j] + size[i], i))
            continue
        if both > room(j):
            continue
        size[j] = both
        alive[i] = False
        after[j] = after[i]
        if after[i] < n:
            before[after[i]] = j
            if j == 0:  # what was too large for another piece may fit the first one
                heapq.heappush(heap, (seg[after[i]][2], size[0] + size[after[i]], after[i]))
    starts = _widened(seg, [i for i in range(n) if alive[i]], overlap, room)
    out, start = [], 0
    for k, (i, e) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
        end = seg[e][0] if e < n else len(text)
        own = sum(s[1] for s in seg[i:e])
        out.append((start, end, own + (overlap if k else 0), own))
        back, have = e, 0
        while have < overlap and back:
            back -= 1
            have += seg[back][1]
        start = [m.start() for m in TOKEN.finditer(text, seg[back][0], end)][-overlap] if overlap else end
    return out


def _widened(seg: list[tuple[int, int, int]], starts: list[int], overlap: int, room: Callable[[int], int]) -> list[int]:
    """starts, moved so that pieces with fewer own than shared tokens share a neighbour's text, where a natural boundary allows it."""
    n = len(seg)
    starts = [*starts, n]
    own = lambda k: sum(s[1] for s in seg[starts[k] : starts[k + 1]])
    for k in range(1, len(starts) - 1):
        if own(k) >= overlap:
            continue
        best = []
        for c in (k, k + 1):  # the boundary before the piece, and the one after it
            if c + 1 >= len(starts):
                continue
            left, total = 0, own(c - 1) + own(c)
            for i in range(starts[c - 1] + 1, starts[c + 1]):
                left += seg[i - 1][1]
                if overlap <= left <= room(c - 1) and overlap <= total - left <= room(c) and seg[i][2] >= min(seg[starts[c]][2], CLAUSE):
                    best.append((-seg[i][2], abs(total - 2 * left), c, i))
        if best:
            _, _, c, i = min(best)
            starts[c] = i
    return starts[:-1]


def split_texts(documents: DataFrame, max_tokens: int, overlap_tokens: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece_no, n_pieces, start_char, end_char, n_tokens, text): the pieces of every text of more than max_tokens tokens.

    start_char and end_char count characters from 0, the end excluded. NULL and empty texts are never too large; equal texts are cut each
    for itself and alike; texts of any length are cut whole; further columns are not read; no documents give no rows.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no int, n_pieces int, start_char int, end_char int, n_tokens int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            row, rest, bodies = [], [], []
            for r, t in enumerate(texts):
                pieces = cut(t, max_tokens, overlap_tokens)
                for k, (a, b, n, _) in enumerate(pieces):
                    row.append(r)
                    rest.append((k, len(pieces), a, b, n))
                    bodies.append(t[a:b])
            cols = list(zip(*rest, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row, pa.int32())), *(pa.array(c, pa.int32()) for c in cols), pa.array(bodies, pa.string())],
                names=["doc_id", "piece_no", "n_pieces", "start_char", "end_char", "n_tokens", "text"],
            )

    # a text has no more tokens than characters; the comparison first spares the count for short texts
    large = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter((F.length("text") > max_tokens) & (wordpunct_count(F.col("text")) > max_tokens))
    return large.mapInArrow(run, schema)


def limit_of(sizes: DataFrame, task: str) -> tuple[int, int]:
    """(max_tokens, overlap_tokens) of a task in size_limits."""
    rows = sizes.filter(F.col("task") == task).select("max_tokens", "overlap_tokens").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"size_limits must have one row for {task}")
    return int(rows[0][0]), int(rows[0][1] or 0)


def oversized(documents: DataFrame, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """(doc_id): texts that split_texts cuts."""
    return split_texts(documents, max_tokens, overlap_tokens).filter("piece_no = 0 and n_pieces > 1").select("doc_id")
