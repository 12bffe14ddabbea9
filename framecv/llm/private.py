"""Personal data with a semi-Markov conditional random field.

Fixed patterns give the base spans. The field scores whole candidate segments: each region of a text that may hold personal
data is cut into atoms, every run of a bounded number of atoms is a candidate for every type, and dynamic programming
chooses boundaries and types together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from framecv.llm.common import bounded_sample, quoted, without

#: The base patterns by kind, in the order in which kinds are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: A segment has at most so many atoms.
LONGEST = 12
WIDTH = 1 << 14
RESULT = ("base", "spans")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[+(]?[0-9](?:[0-9]|[\x20().+-]{1,3}(?=[0-9(]))*[0-9)]")
_AT = re.compile(r"@|\x20?[(\[]at[)\]]\x20?|\x20at\x20(?=[A-Za-z0-9-]+\x20?[(\[]?dot\b)", re.I | re.A)
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+", re.I | re.A)
_ATOM = re.compile(r"[+(]*[0-9]+\)?")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from their @ signs: a match starts where the run of local characters before its @ starts, or
    where the match before ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost and non-overlapping in each kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# ---- candidates and features -----------------------------------------------------------------

def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Stretches that may hold personal data, as lists of atoms. Numbers: groups of digits with their signs; addresses with
    an at sign, also a spelled one: one atom."""
    taken: list[tuple[int, int]] = []
    for m in _AT.finditer(text):
        start, host = m.start(), _HOST.match(text, m.end())
        while start > (taken[-1][1] if taken else 0) and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < m.start():
            taken.append((start, host.end()))
            yield [taken[-1]]
    k = 0
    for m in _REGION.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        atoms = [a.span() for a in _ATOM.finditer(text, m.start(), m.end())]
        if sum(b - a for a, b in atoms) >= 4:
            yield atoms


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def segment_features(text: str, atoms: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Of the whole segment of the atoms i to j - 1, independent of its type."""
    start, end = atoms[i][0], atoms[j - 1][1]
    body = text[start:end]
    digits = _digits(body)
    groups = [len(_digits(text[a:b])) for a, b in atoms[i:j]]
    signs = "".join(sorted({c for c in body if not c.isalnum()}))
    before = _WORD.findall(text[max(0, start - 24):start].lower())
    out = ["bias", f"atoms={min(j - i, 6)}", f"digits={min(len(digits), 20)}", f"signs={signs}", f"first={body[:1] if not body[:1].isalnum() else 'x'}",
           f"groups={'-'.join(map(str, groups[:6]))}", f"whole={i == 0 and j == len(atoms)}", f"before={before[-1] if before else ''}",
           f"luhn={13 <= len(digits) <= 19 and luhn(digits)}", f"at={'@' in body}", f"word={any(c.isalpha() for c in body)}",
           f"octets={len(groups) == 4 and all(g <= 3 for g in groups) and all(int(_digits(text[a:b])) <= 255 for a, b in atoms[i:j] if b > a)} {signs}",
           f"left={text[start - 1:start] if start else ''}", f"right={text[end:end + 1]}"]
    return [_number(f) for f in out]


def segments(text: str, atoms: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    return [(i, j, segment_features(text, atoms, i, j)) for i in range(len(atoms)) for j in range(i + 1, min(i + LONGEST, len(atoms)) + 1)]


# ---- the field -------------------------------------------------------------------------------

def _lattice(model: np.ndarray, found: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """Score of each segment as each type."""
    return model[np.array([x for _, _, x in found])].sum(axis=1)


def train_field(data: list[tuple[int, list[tuple[int, int, list[int]]], set[tuple[int, int, int]]]], rounds: int = 60, rate: float = 0.1,
                decay: float = 1e-4) -> np.ndarray:
    """data: number of atoms, segments with features, true (i, j, type). An atom outside of all entities scores 0.

    Conditional likelihood with sums over all segmentations, climbed with Adam. Regions of one number of atoms are
    taken together.
    """
    model = np.zeros((WIDTH, len(KINDS)))
    mean, square = np.zeros_like(model), np.zeros_like(model)
    groups: dict[int, list] = {}
    for n, found, true in data:
        groups.setdefault(n, []).append((found, true))
    packed = []
    for n, members in groups.items():
        spots = [(i, j) for i, j, _ in members[0][0]]
        x = np.array([[f for _, _, f in found] for found, _ in members])
        y = np.zeros((len(members), len(spots), len(KINDS)))
        for k, (_, true) in enumerate(members):
            for i, j, kind in true:
                y[k, spots.index((i, j)), kind] = 1
        packed.append((n, spots, x, y))
    total = max(1, len(data))
    for step in range(1, rounds + 1 if data else 1):
        grad = decay * model
        for n, spots, x, y in packed:
            score = model[x].sum(axis=2)
            any_type = np.logaddexp.reduce(score, axis=2)
            m = len(x)
            ahead, back = np.full((m, n + 1), -np.inf), np.full((m, n + 1), -np.inf)
            ahead[:, 0] = back[:, n] = 0
            for j in range(1, n + 1):
                ahead[:, j] = ahead[:, j - 1]
                for s, (a, b) in enumerate(spots):
                    if b == j:
                        ahead[:, j] = np.logaddexp(ahead[:, j], ahead[:, a] + any_type[:, s])
            for i in range(n - 1, -1, -1):
                back[:, i] = back[:, i + 1]
                for s, (a, b) in enumerate(spots):
                    if a == i:
                        back[:, i] = np.logaddexp(back[:, i], any_type[:, s] + back[:, b])
            begin, end = np.array([a for a, _ in spots]), np.array([b for _, b in spots])
            belief = np.exp(ahead[:, begin, None] + score + back[:, end, None] - ahead[:, n][:, None, None])
            np.add.at(grad, x, ((belief - y) / total)[:, :, None, :])
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        model -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return model


def best_segments(model: np.ndarray, n: int, found: list[tuple[int, int, list[int]]], caution: float = 0.0) -> list[tuple[int, int, int]]:
    """(i, j, type) of the best segmentation. caution is taken off each entity's score."""
    if not found:
        return []
    score = _lattice(model, found) - caution
    kind, high = score.argmax(axis=1).tolist(), score.max(axis=1).tolist()
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j, _) in enumerate(found):
        ending[j].append(s)
    best, link = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in ending[j]:
            value = best[found[s][0]] + high[s]
            if value > best[j]:
                best[j], link[j] = value, s
    out, j = [], n
    while j:
        s = link[j]
        if s < 0:
            j -= 1
        else:
            out.append((found[s][0], found[s][1], kind[s]))
            j = found[s][0]
    return out[::-1]


def labelled_regions(text: str) -> Iterator[tuple[int, list, set]]:
    spans = {(a, b): KINDS.index(k) for k, a, b in reversed(base_spans(text))}
    for atoms in regions(text):
        found, true, last = segments(text, atoms[:LONGEST]), set(), 0
        for i, j, _ in sorted(found, key=lambda f: (f[0], -f[1])):
            kind = spans.get((atoms[i][0], atoms[j - 1][1]))
            if kind is not None and i >= last:
                true.add((i, j, kind))
                last = j
        yield min(len(atoms), LONGEST), found, true


def train_private(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 4_000) -> np.ndarray:
    """Fit the field on the regions of the sample_rows texts with a digit or an at sign that have the smallest hash of their
    id; the base patterns label them. The bound is a parameter; only the sample reaches the driver."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    picked = bounded_sample(rows, "id", sample_rows).select("text").toLocalIterator()
    return train_field([x for row in picked for x in labelled_regions(row.text)])


def find_private(df: DataFrame, model: np.ndarray, text_col: str = "text", caution: float = 2.0) -> DataFrame:
    """df with base and spans: arrays of (kind, start, end) in code points, end exclusive, by kind as listed, then start.

    spans holds the base spans and those of the field that overlap none of them. Whole texts are read, each in the task
    that holds the row; a region of more atoms than a segment may have is decoded over all of them. Null texts are
    empty and have no spans. Columns of df with a result's name are left out.
    """
    base = without(df, RESULT)
    names, shared = base.columns, df.sparkSession.sparkContext.broadcast(model)  # WIDTH * 4 numbers
    at = names.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, found = [], []
            for value in batch.column(at):
                text = value.as_py() or ""
                own = base_spans(text)
                spans = list(own)
                for atoms in regions(text):
                    if any(a <= atoms[0][0] and atoms[-1][1] <= b for _, a, b in own):
                        continue
                    for i, j, kind in best_segments(shared.value, len(atoms), segments(text, atoms), caution):
                        start, end = atoms[i][0], atoms[j - 1][1]
                        if not any(start < b and a < end for _, a, b in own):
                            spans.append((KINDS[kind], start, end))
                bases.append(own)
                found.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))
            pack = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in column], arrow) for column in (bases, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *pack], [*names, *RESULT])

    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(n, span) for n in RESULT]))
