"""Transcript parsing: a hidden Markov model over speaker markers and line features recovers roles, then turns are rendered.

States are roles, observations the lines of a conversation's rows in order. A line shows its speaker marker (if any),
its length and its ending; the first line of a row also shows the row's length and number of lines. Emissions and transitions (from line to
line within a row, and from row to row) are counted on a bounded sample of labelled rows; the role column is no input of a
prediction. Log-probabilities are integers, so sums over any split of a conversation are exact.

A conversation of any length spreads over pieces: a first pass reduces what each piece holds of a conversation that
may go on elsewhere to a states x states table, the driver chains these (two for each piece at most), and a second
pass labels every piece from the right beginning to the right end.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, piece_of, ranked, read, share_code, splitters, written

ROLES = ("system", "user", "assistant")
#: Speakers as transcripts name them. Fixed values.
MARKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "you", "question", "q", "customer", "client", "prompter", "instruction"),
    "assistant": ("assistant", "ai", "bot", "gpt", "answer", "a", "agent", "response", "model"),
}
_NAMES = {n: r for r, names in MARKERS.items() for n in names}
_MARKER = re.compile(rf"\s*(?:<\|im_start\|>\s*({'|'.join(MARKERS)})\s*$|(?:#{{1,4}}\s*|\*\*|\[|<\|?)?({'|'.join(sorted(_NAMES, key=len, reverse=True))})(?:\*\*)?(?::(?:\*\*)?|\]:?|\|?>|\)(?=\s))\s*)", re.I)
_END = re.compile(r"\s*<\|im_end\|>\s*$")
#: Conversations that the model is fitted on, about; log-probabilities are in thousandths.
SAMPLE, UNIT = 20_000, 1_000
#: Log-probability of a marker given its speaker, of another, and of a switch within a row, before any counts.
MARKED, STRANGE, SWITCH = -1.0, -40.0, 0.001
#: Rows of a piece, about, and how many pieces there are at least and at most.
PIECE_ROWS, PIECES = 20_000, (64, 20_000)


def split(text: str | None) -> list[tuple[str, str | None]]:
    """Lines that aren't blank, each without its marker, and the role that the marker names."""
    out = []
    for line in (text or "").splitlines():
        if not line.strip():
            continue
        m = _MARKER.match(line)
        role = (m[1] or _NAMES[m[2].lower()]).lower() if m else None
        rest = _END.sub("", line[m.end() :] if m else line)
        if rest.strip() or m:
            out.append((rest, role))
    return out


def observations(lines: list[tuple[str, str | None]]) -> list[list[tuple[str, int]]]:
    """Features of each line: (name, value)."""
    out = []
    size = sum(len(t) for t, _ in lines)
    for i, (text, _) in enumerate(lines):
        end = text.rstrip()[-1:]
        f = [("length", len(text).bit_length()), ("end", 2 if end == "?" else 1 if end in ".!" else 0)]
        out.append(f + [("rows", min(len(lines), 12)), ("size", int(2 * np.log2(size + 1)))] if i == 0 else f)
    return out


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    turn: np.ndarray  # from the last line of a row to the first of the next
    line: np.ndarray  # within a row
    emit: dict  # (feature, value) -> scores by state
    unseen: dict  # feature -> scores by state

    def scores(self, text: str | None) -> tuple[list, np.ndarray]:
        parts = split(text)
        out = np.zeros((len(parts), len(ROLES)), np.int64)
        for k, (features, (_, marker)) in enumerate(zip(observations(parts), parts, strict=True)):
            for f in features:
                out[k] += self.emit.get(f, self.unseen[f[0]])
            if marker:
                out[k] += [round(UNIT * (MARKED if r == marker else STRANGE)) for r in ROLES]
        return parts, out


def held_out(conv: Column) -> Column:
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter = Counter()
        for text, role in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for f in observations(split(text)):
                n.update((role, name, value) for name, value in f)
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())], ["role", "feature", "value", "n"])


def fit(spark: SparkSession, rows: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from labelled rows of conversations that aren't held out, about `sample` of them by hash; roles other
    than ROLES and null ones don't count. Without any labels, markers and even odds remain."""
    share_code(spark)
    role = F.lower(F.trim("role"))
    known = rows.select("conv_id", "turn", "text", role.alias("role")).filter(role.isin(*ROLES) & ~held_out(F.col("conv_id")))
    convs = known.select(F.approx_count_distinct("conv_id")).first()[0]
    u = F.shiftrightunsigned(F.xxhash64("conv_id"), 12) / F.lit(float(1 << 52))
    known = known.filter(u < sample / max(sample, convs, 1))
    once = known.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    later = once.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    pairs = {(r["role"], r["next"]): r["count"] for r in once.join(later, ["conv_id", "turn"]).groupBy("role", "next").count().collect()}
    starts = {r["role"]: r["count"] for r in once.filter("turn = 0").groupBy("role").count().collect()}
    seen = known.select("text", "role").mapInArrow(_observed, "role string, feature string, value long, n long").groupBy("role", "feature", "value").agg(F.sum("n").alias("n")).collect()

    def logs(counts: np.ndarray) -> np.ndarray:
        return np.round(UNIT * np.log(counts / counts.sum(axis=-1, keepdims=True))).astype(np.int64)

    start = logs(np.array([starts.get(r, 0) + 0.5 for r in ROLES]))
    turn = logs(np.array([[pairs.get((a, b), 0) + 0.1 for b in ROLES] for a in ROLES]))
    line = logs(np.where(np.eye(len(ROLES)) > 0, 1.0, SWITCH))
    emit, unseen = {}, {}
    by_feature = {f: [r for r in seen if r.feature == f] for f in ("length", "end", "rows", "size")}
    for f, found in by_feature.items():
        values = sorted({r.value for r in found})
        n = {(r.role, r.value): r.n for r in found}
        table = logs(np.array([[n.get((r, v), 0) + 0.5 for v in values] + [0.5] for r in ROLES])).T
        emit |= {(f, v): table[i] for i, v in enumerate(values)}
        unseen[f] = table[-1]
    return Model(start, turn, line, emit, unseen)


def _forward(model: Model, v: np.ndarray | None, scores: np.ndarray, back: list | None = None) -> np.ndarray:
    """Best scores after a row's lines. v: those before it (the last axis by state), None at a beginning; `back` gets the
    scores before each line."""
    for k, s in enumerate(scores):
        if back is not None:
            back.append((v, k > 0))
        v = model.start + s if v is None else (v[..., :, None] + (model.line if k else model.turn)).max(axis=-2) + s
    return v


def _runs(batches: Iterator[pa.RecordBatch]):
    """Rows (piece, conv_id, turn, text), grouped by piece and conversation."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return itertools.groupby(rows, key=lambda r: (r[0], r[1]))


def _tables(model: Model):
    """For the first and the last conversation of each piece: piece, conv_id, last, begin (scores from a beginning; empty without lines),
    table (scores from each state before it)."""
    n = len(ROLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, now = [], None, None
        for (piece, conv), rows in _runs(batches):
            first = piece != now
            if first and held:
                out.append(held)
            now = piece
            begin, table = None, np.where(np.eye(n) > 0, 0, -(10**15)).astype(np.int64)
            for r in rows:
                scores = model.scores(r[3])[1]
                begin, table = _forward(model, begin, scores), _forward(model, table, scores)
            # A piece's first run is sent at once, its last when the piece has ended.
            entry = (piece, conv, [] if begin is None else begin.tolist(), table.ravel().tolist())
            held = None if first else entry
            if first:
                out.append(entry)
        if held:
            out.append(held)
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["piece", "conv_id", "begin", "table"])

    return run


def chain(entries: list[tuple], n: int = len(ROLES)) -> tuple[dict, dict]:
    """From (piece, conv, begin, table) in order: by piece, the scores with which its first conversation goes on; by piece
    and conversation, the state in which what the piece holds of a conversation over several pieces must end."""
    into, end = {}, {}
    for _, group in itertools.groupby(enumerate(entries), key=lambda e: e[1][1]):
        parts = [e for _, e in group]
        v, seen = None, []
        for piece, _, begin, table in parts:
            seen.append(v)
            if v is not None:
                into[piece] = v.tolist()
                v = (v[:, None] + np.array(table).reshape(n, n)).max(axis=0)
            elif begin:
                v = np.array(begin)
        if v is None:
            continue
        state = int(v.argmax())
        for (piece, conv, _, table), before in zip(reversed(parts), reversed(seen), strict=True):
            if len(parts) > 1:
                end[piece, conv] = state
            if before is None:
                break
            state = int((before + np.array(table).reshape(n, n)[:, state]).argmax())
    return into, end


def _labelled(model: Model, into: dict, end: dict):
    kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role_pred", pa.string()), ("n_turns", pa.int32()), ("rendered", pa.string())]

    def label(rows: list[tuple], v: np.ndarray | None, state: int | None) -> list[tuple]:
        back, parts = [], []
        scored = []
        for r in rows:
            lines, scores = model.scores(r[3])
            parts.append(lines)
            scored.append(scores)
            v = _forward(model, v, scores, back)
        states = [0] * len(back)
        if back:
            state = int(v.argmax()) if state is None else state
            for k in range(len(back) - 1, -1, -1):
                states[k] = state
                before, inside = back[k]
                if before is not None:
                    state = int((before + (model.line if inside else model.turn)[:, state]).argmax())
        at = 0
        out = []
        for r, lines in zip(rows, parts, strict=True):
            mine = states[at : at + len(lines)]
            at += len(lines)
            turns = [(ROLES[s], "\n".join(t for _, (t, _) in g)) for s, g in itertools.groupby(zip(mine, lines, strict=True), key=lambda x: x[0])]
            weight: Counter = Counter()
            for role, text in turns:
                weight[role] += len(text) + 1
            out.append((r[1], r[2], max(weight, key=weight.get) if weight else None, len(turns), render(turns)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for (piece, conv), rows in _runs(batches):
            first, now = piece != now, piece
            v = into.get(piece) if first else None
            out += label(list(rows), None if v is None else np.array(v), end.get((piece, conv)))
            if len(out) > 2_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return run


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical turns. Control marks in a text are broken up, so that they can't open or close a turn."""
    return "".join(f"<|im_start|>{role}\n{text.strip().replace('<|', '< |')}<|im_end|>\n" for role, text in turns)


def parse(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, role_pred (the role of most of the row's text), n_turns and rendered (the row's turns in canonical
    form) of every row of `rows` (conv_id, turn, text).

    Rows count in the order of turn (null last), then of text; rows that repeat exactly are so many turns, and each is
    returned. A null or blank text has no turns and no role. Rows without conv_id are one conversation. A transcript is a
    conversation of one row. A conversation of any length, and a text of any, is labelled as a whole; an empty table gives
    no rows; other columns are left out."""
    share_code(spark)
    base = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text", F.monotonically_increasing_id().alias("n_"))
    base = written(spark, base, "turns")
    base = base.withColumns({"c_": F.coalesce("conv_id", F.lit(-(2**63))), "t_": F.coalesce("turn", F.lit(2**63 - 1)), "h_": F.xxhash64("text")})
    keys, types = ["c_", "t_", "h_", "n_"], ["long"] * 4
    places = ranked(spark, base.select(*keys), keys)
    n = places.count()
    cuts = splitters(places, keys, n, max(PIECES[0], min(PIECES[1], n // PIECE_ROWS)))
    dealt = base.withColumn("piece", piece_of([F.col(k) for k in keys], types, cuts)).repartitionById(len(cuts) + 1, F.col("piece")).sortWithinPartitions("piece", *keys, "text")
    dealt = dealt.select("piece", "conv_id", "turn", "text")
    entries = [(r.piece, r.conv_id, r.begin, r.table) for r in dealt.mapInArrow(lean(_tables(model)), "piece int, conv_id long, begin array<long>, table array<long>").collect()]
    entries.sort(key=lambda e: e[0])  # of a piece, the first run comes before the last
    into, end = chain(entries)
    return dealt.mapInArrow(lean(_labelled(model, into, end)), "conv_id long, turn long, role_pred string, n_turns int, rendered string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: roles recovered from the texts of all conversations, and their canonical turns."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", "role")
    return parse(spark, rows, fit(spark, rows)).select("conv_id", "turn", held_out(F.col("conv_id")).alias("held_out"), "role_pred", "n_turns", "rendered")
