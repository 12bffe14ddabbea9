"""Secret scans with a linear-chain conditional random field.

Fixed patterns give the base spans. A chain over the tokens of a text tags each token as begin, inside or outside of a secret,
from its shape, the words next to it and features of the whole text, and adds the spans that it finds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from framecv.llm.common import bounded_sample, quoted, without

#: The base patterns by kind, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
ADDED = "other"

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
WIDTH = 1 << 14
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+")
_ANY = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]++")
#: Signs of an assignment, quotes that are no apostrophes, and strings that are long or change between lower and upper case.
_ANCHOR = re.compile(r"""["`=:]|(?<![A-Za-z])'|'(?![A-Za-z])|[A-Za-z0-9+/_.=-]{20,}+|[a-z][A-Z]""")
#: All tokens that start within so many characters of an anchor are in the chain.
NEAR = 48
#: Tokens that are decoded at a time.
TOKENS = 1 << 16
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"[A-Za-z]+")
_ASSIGNED = re.compile(r"pass|secret|token|api", re.I | re.A)
RESULT = ("base", "spans")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; leftmost and non-overlapping in each kind."""
    found = []
    if _ASSIGNED.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # a run of hex digits is a match as a whole, so the long ones are those of 32 and more
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def capable(token: str) -> bool:
    """Tokens with a digit that are in the chain wherever they stand: 8 characters with a letter, or 20 of any kind."""
    return len(token) >= 20 or len(token) >= 8 and any(c.isalpha() for c in token)


def _shape(token: str) -> str:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c for c in token]
    return "".join(c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1])[:12]


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def features(text: str, start: int, end: int, file: list[int]) -> list[int]:
    token = text[start:end]
    before, after = text[max(0, start - 24):start], text[end:end + 16]
    words = _WORD.findall(before.lower())
    following = _WORD.findall(after.lower())
    digits = sum(c.isdigit() for c in token)
    gap, bare = before[-1:], before.rstrip(" \"'")
    sign = bare[-1:] if bare[-1:] in ("=", ":") else ""
    return [_number(f) for f in (
        "bias", f"shape={_shape(token)}", f"runs={min(len(_shape(token)), 9)}", f"length={min(len(token) // 4, 12)}", f"digits={10 * digits // len(token)}",
        f"entropy={int(2 * _entropy(token))}", f"hex={bool(re.fullmatch('[0-9a-f]+', token))}", f"prefix={token[:4] if token[:4].isalpha() else ''}",
        f"before={words[-1] if words else ''}", f"gap={gap}", f"sign={sign}",
        f"after={following[0] if following else ''}", f"next={after[:1]}")] + file


def file_features(text: str) -> list[int]:
    """Of the whole text: its share of digits, assignment signs and line ends."""
    n = max(len(text), 1)
    return [_number(f"file {name}={min(int(math.log2(1 + 1000 * text.count(sign) / n)), 9)}") for name, sign in (("assigns", "="), ("lines", "\n"), ("quotes", '"'))]


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens with nothing but blanks, quotes and signs between them: the capable ones, and all, with digits or not, of
    the neighbourhoods of anchors. What is not in a run is outside of secrets: words of plain prose, far from any anchor."""
    spans = {m.span() for m in _TOKEN.finditer(text) if capable(m[0])}
    at = 0
    for anchor in _ANCHOR.finditer(text):
        end = anchor.end() + NEAR
        for m in _ANY.finditer(text, max(anchor.start() - NEAR, at)):
            if m.start() >= end:
                break
            at = m.end()
            if any(map(str.isalnum, m[0])):
                spans.add(m.span())
    runs: list[list[tuple[int, int]]] = []
    for a, b in sorted(spans):
        if runs and not text[runs[-1][-1][1]:a].strip(" \"'`=:,;"):
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
    return runs


@dataclass
class Chain:
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray


#: Inside cannot follow outside or come first.
_BARRED = np.zeros((3, 3))
_BARRED[OUTSIDE, INSIDE] = -1e4
_BARRED_FIRST = np.array([0.0, -1e4, 0.0])


def _by_length(runs: list[list[list[int]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the runs, their features) for each length."""
    groups: dict[int, list[int]] = {}
    for i, run in enumerate(runs):
        groups.setdefault(len(run), []).append(i)
    for own in groups.values():
        yield np.array(own), np.array([runs[i] for i in own])


def train_chain(runs: list[list[list[int]]], tags: list[list[int]], rounds: int = 80, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """Conditional likelihood by forward and backward sums over all runs, climbed with Adam."""
    model = Chain(np.zeros((WIDTH, 3)), np.zeros((3, 3)), np.zeros(3))
    parts = [model.emit, model.move, model.first]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    data = [(x, np.array([tags[i] for i in own])) for own, x in _by_length(runs)]
    total = max(1, sum(x.shape[0] * x.shape[1] for x, _ in data))
    for step in range(1, rounds + 1 if data else 1):
        grads = [decay * p for p in parts]
        for x, y in data:
            score = model.emit[x].sum(axis=2)
            n, length, _ = score.shape
            move, first = model.move + _BARRED, model.first + _BARRED_FIRST
            ahead = np.zeros_like(score)
            ahead[:, 0] = first + score[:, 0]
            for t in range(1, length):
                ahead[:, t] = score[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1)
            back = np.zeros_like(score)
            for t in range(length - 2, -1, -1):
                back[:, t] = np.logaddexp.reduce(move + (score[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            all_ = np.logaddexp.reduce(ahead[:, -1], axis=1)
            belief = np.exp(ahead + back - all_[:, None, None])
            error = belief.copy()
            np.put_along_axis(error, y[..., None], np.take_along_axis(error, y[..., None], 2) - 1, 2)
            np.add.at(grads[0], x, (error / total)[:, :, None, :])
            grads[2] += error[:, 0].sum(axis=0) / total
            for t in range(1, length):
                pair = np.exp(ahead[:, t - 1, :, None] + move + (score[:, t] + back[:, t])[:, None, :] - all_[:, None, None]).sum(axis=0)
                np.add.at(pair, (y[:, t - 1], y[:, t]), -1)
                grads[1] += pair / total
        for p, g, m, s in zip(parts, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return model


def decode(model: Chain, runs: list[list[list[int]]], caution: float = 0.0) -> list[list[int]]:
    """Tags of each run by Viterbi. caution is taken off the score of begin and inside."""
    out: list[list[int]] = [[] for _ in runs]
    move, first = model.move + _BARRED, model.first + _BARRED_FIRST
    for own, x in _by_length(runs):
        score = model.emit[x].sum(axis=2)
        score[:, :, OUTSIDE] += caution
        best, links = first + score[:, 0], []
        for t in range(1, score.shape[1]):
            ways = best[:, :, None] + move
            links.append(ways.argmax(axis=1))
            best = score[:, t] + ways.max(axis=1)
        tags = [best.argmax(axis=1)]
        for link in reversed(links):
            tags.append(link[np.arange(len(own)), tags[-1]])
        for i, path in zip(own.tolist(), np.stack(tags[::-1], axis=1).tolist()):
            out[i] = path
    return out


def labelled_runs(text: str) -> Iterator[tuple[list[list[int]], list[int]]]:
    """Features and tags of a text's runs. A token is of a secret if it meets a base span (of an assignment: its value)."""
    spans = [(a, b) for kind, a, b in base_spans(text) if kind != "assign"]
    spans += [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    file = file_features(text)
    for run in chains(text):
        tags, last = [], None
        for a, b in run:
            span = next((s for s in spans if a < s[1] and s[0] < b), None)
            tags.append(OUTSIDE if span is None else INSIDE if span == last else BEGIN)
            last = span
        yield [features(text, a, b, file) for a, b in run], tags


def train_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = 4_000,
                  sample_tokens: int = 400_000) -> Chain:
    """Fit the chain on the runs of the sample_rows texts with a digit or an anchor that have the smallest hash of their id, in
    this order until sample_tokens tokens are reached; the base patterns label them. The bounds are parameters; only the
    sample reaches the driver."""
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text")).where(
        F.col("text").rlike("[0-9=:\"'`]|[A-Za-z+/_.-]{20}|[a-z][A-Z]"))
    picked = bounded_sample(rows, "id", sample_rows).select("text").toLocalIterator()
    runs, tags, held = [], [], 0
    for row in picked:
        for x, y in labelled_runs(row.text):
            runs.append(x)
            tags.append(y)
            held += len(x)
        if held >= sample_tokens:
            break
    return train_chain(runs, tags)


def find_secrets(df: DataFrame, model: Chain, text_col: str = "text", caution: float = 2.0) -> DataFrame:
    """df with base and spans: arrays of (kind, start, end) in code points, end exclusive, by start, then kind as listed.

    spans holds the base spans and, with the kind `other`, the spans of the chain that overlap none of them. Whole texts
    are read, each in the task that holds the row. Null texts are empty and have no spans. Columns of df with a
    result's name are left out.
    """
    base = without(df, RESULT)
    names, shared = base.columns, df.sparkSession.sparkContext.broadcast(model)  # WIDTH * 3 numbers
    at = names.index(text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, found, runs, where, held = [], [], [], [], 0

            def settle() -> None:
                for (i, r), tags in zip(where, decode(shared.value, runs, caution)):
                    k = 0
                    while k < len(r):
                        if tags[k] == OUTSIDE:
                            k += 1
                            continue
                        start, end = r[k]
                        k += 1
                        while k < len(r) and tags[k] == INSIDE:
                            end = r[k][1]
                            k += 1
                        if not any(start < y and x < end for _, x, y in bases[i]):
                            found[i].append((ADDED, start, end))
                runs.clear()
                where.clear()

            for i, value in enumerate(batch.column(at)):
                text = value.as_py() or ""
                own = base_spans(text)
                bases.append(own)
                found.append(list(own))
                tokens = chains(text)
                if tokens:
                    file = file_features(text)
                    for r in tokens:
                        if any(not any(a < y and x < b for _, x, y in own) for a, b in r):
                            runs.append([features(text, a, b, file) for a, b in r])
                            where.append((i, r))
                            held += len(r)
                if held >= TOKENS:
                    settle()
                    held = 0
            settle()
            order = {k: n for n, k in enumerate((*KINDS, ADDED))}
            found = [sorted(s, key=lambda x: (x[1], order[x[0]])) for s in found]
            pack = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in column], arrow) for column in (bases, found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *pack], [*names, *RESULT])

    return base.mapInArrow(run, T.StructType(base.schema.fields + [T.StructField(n, span) for n in RESULT]))
