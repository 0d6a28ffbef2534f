"""Language identification: scripts narrow the candidates, character trigrams score words, Viterbi labels spans.

A word is a run of letters. Its script leaves the languages that were seen in that script; each gets the sum of its
trigrams' log-probabilities. Viterbi over the words of a text, with a penalty for every switch of language, labels
spans; the document's language is the one with most letters. The model is fitted on a bounded sample of labelled rows;
every text is labelled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, share_code

#: Trigrams are hashed to this many buckets.
BUCKETS = 1 << 16
#: Documents of each language that the model is fitted on, about: those whose hash falls below a threshold from counts.
#: Languages that are learned at most, those of most documents: the model's table grows with them.
SAMPLE, LABELS = 3_000, 256
#: Log-probability that a switch of language costs, in nats.
SWITCH = 12.0
#: A text is of no language if less than this share of its letters is in any one: a text in one language that quotes others,
#: or a short one with a notice in another, still is of its own.
LEAST = 0.3
#: Words whose scores are held at once, times languages; letters too.
BLOCK = 2_000_000
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.01
#: First code points of ranges, and the script that begins there (0: none in particular).
SCRIPTS = (
    (0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "Syriac"), (0x750, "Arabic"), (0x780, "Thaana"),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "Oriya"), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, "Kannada"),
    (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 1 for a letter, 2 for a mark that may go on a word, else 0; the lower-case code point (if it is a
    single one); the script."""
    top = 0x110000
    letter, lower, script = np.zeros(top, dtype=np.uint8), np.arange(top, dtype=np.uint32), np.zeros(top, dtype=np.uint8)
    for c in range(0x40000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            letter[c] = 1
            if len(low := s.lower()) == 1:
                lower[c] = ord(low)
        elif unicodedata.category(s)[0] == "M":
            letter[c] = 2 * (c >= 0x900)  # vowel signs are part of words, and make none
    for (at, name), (end, _) in zip(SCRIPTS, (*SCRIPTS[1:], (top, "")), strict=True):
        script[at:end] = NAMES.index(name)
    return letter, lower, script


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs, float32: log-probabilities
    scripts: np.ndarray  # scripts x langs, bool
    prior: int  # the language with most sampled letters


def features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' letters in order: trigram buckets, and for each word where its letters begin there, where it begins
    in the text, and its script."""
    letter, lower, script = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = letter[codes]
    at = np.flatnonzero(kind)
    if (kind == 2).any():  # a run of marks alone is no word
        starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        words = np.maximum.reduceat(kind[at] == 1, starts)
        at = at[np.repeat(words, np.diff(starts, append=len(at)))]
    is_letter = np.zeros(len(codes), dtype=bool)
    is_letter[at] = True
    if not len(at):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    plain = np.full(len(codes) + 2, 32, dtype=np.uint32)
    plain[1:-1][is_letter] = lower[codes[at]]
    bucket = (plain[at] * np.uint32(0x9E3779B1)) ^ (plain[at + 1] * np.uint32(0x85EBCA6B)) ^ (plain[at + 2] * np.uint32(0xC2B2AE35))
    bucket = (bucket ^ (bucket >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return (bucket >> np.uint32(16)).astype(np.int64), starts, at[starts], script[codes[at[starts]]].astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, kind (0 trigram, 1 script), slot, n: sums over a batch."""
    for b in batches:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            bucket, starts, _, script = features(text.as_py())
            grams, scripts = sums.setdefault(lang.as_py(), (np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64)))
            grams += np.bincount(bucket, minlength=BUCKETS)
            scripts += np.bincount(script, weights=np.diff(starts, append=len(bucket)), minlength=len(NAMES)).astype(np.int64)
        for lang, both in sums.items():
            for kind, s in enumerate(both):
                slot = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(np.full(len(slot), kind), pa.int32()), pa.array(slot, pa.int32()), pa.array(s[slot], pa.int64())], ["lang", "kind", "slot", "n"])


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model from text and lang of labelled rows that aren't held out; None if there are none.

    About `sample` documents of each language are read, those whose hash of id and text is least: a threshold from the
    languages' counts, so no language is sorted or gathered. Of more than LABELS languages, those of most documents (then the
    least in order) are learned. The driver gets at most BUCKETS counts a language."""
    share_code(spark)
    known = docs.select("text", "lang", "doc_id").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LABELS).collect()}
    if not sizes:
        return None
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 12) / F.lit(float(1 << 52))
    rate = F.element_at(F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, sample / n))]), F.col("lang"))
    chosen = known.filter((u < rate) | (rate >= 1)).select("text", "lang")
    counts = chosen.mapInArrow(lean(_counts), "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    if not langs:
        return None
    which = np.searchsorted(np.array(langs, dtype=object), np.array(counts.column("lang").to_pylist(), dtype=object))
    kind, slot, n = (counts.column(c).to_numpy() for c in ("kind", "slot", "n"))
    grams, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    grams[slot[kind == 0], which[kind == 0]] = n[kind == 0]
    scripts[slot[kind == 1], which[kind == 1]] = n[kind == 1]
    table = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, table, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0)), int(scripts.sum(axis=0).argmax()))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every row of `scores` (words x languages); `lengths` rows belong to each text.

    All texts advance one word at a time, the longest first, so that those still open are a prefix. Of equal paths the
    one that stays, then the smaller label, wins."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    steps = int(ordered[0]) if len(ordered) else 0
    open_ = np.searchsorted(-ordered, -np.arange(steps), side="left")  # texts with more than t words
    best_from, moved = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
    v = np.zeros((len(order), scores.shape[1]), np.float64)
    end = np.zeros(len(order), np.int64)
    for t in range(steps):
        n = open_[t]
        row, now = starts[:n] + t, v[:n]
        if t:
            top = now.argmax(axis=1)
            by_switch = (now[np.arange(n), top] - switch)[:, None]
            best_from[row], moved[row] = top, by_switch > now
            now = np.maximum(now, by_switch)
        v[:n] = now + scores[row]
    if steps:
        end = v.argmax(axis=1)
    out = np.zeros(len(scores), np.int64)
    label = end
    for t in range(steps - 1, -1, -1):
        n = open_[t]
        row = starts[:n] + t
        out[row] = label[:n]
        if t:
            label[:n] = np.where(moved[row, label[:n]], best_from[row], label[:n])
    return out


def _scores(model: Model, bucket: np.ndarray, starts: np.ndarray, script: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words x languages: the score of each word; and whether no language has its script."""
    s = np.add.reduceat(model.table[bucket], starts, axis=0, dtype=np.float64) if len(starts) else np.zeros((0, len(model.langs)))
    fits = model.scripts[script]
    none = ~fits.any(axis=1)
    s[~fits] = -1e4
    s[none] = 0
    return s, none


def _label_long(model: Model, part: tuple, block: int = BLOCK, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_label() of one text, in blocks of words that hold about `block` letters times languages: a first pass keeps the scores with which
    each block begins, a second one goes back from block to block."""
    bucket, starts, begin, script = part
    size = np.diff(starts, append=len(bucket))
    step = np.searchsorted(starts, np.arange(0, len(bucket), max(1, block // len(model.langs))))
    cuts = [*np.unique(step[step < len(starts)]).tolist(), len(starts)]

    def scores(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        end = starts[b] if b < len(starts) else len(bucket)
        return _scores(model, bucket[starts[a] : end], starts[a:b] - starts[a], script[a:b])

    def forward(v: np.ndarray | None, s: np.ndarray, back: list | None = None) -> np.ndarray:
        for row in s:
            if v is None:
                v = row.copy()
                continue
            top = int(v.argmax())
            moved = v[top] - switch > v
            if back is not None:
                back.append((top, moved))
            v = np.where(moved, v[top] - switch, v) + row
        return v

    v, before, evidence = None, [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        before.append(v)
        s, none = scores(a, b)
        evidence.append(~none)
        v = forward(v, s)
    labels, label = np.zeros(len(starts), np.int64), int(v.argmax())
    for (a, b), v in reversed(list(zip(zip(cuts, cuts[1:], strict=False), before, strict=True))):
        back: list = []
        forward(v, scores(a, b)[0], back)
        for t in range(b - 1, a - 1, -1):
            labels[t] = label
            if t > a or v is not None:
                top, moved = back.pop()
                label = top if moved[label] else label
    return labels, begin, size, np.concatenate(evidence)


def _label(model: Model, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: label, begin (in the text), letters and evidence (false: no candidate in that script) of its words."""
    parts = [features(t) for t in texts]
    if len(parts) == 1 and len(parts[0][0]) * len(model.langs) > BLOCK:
        return [_label_long(model, parts[0])]
    lengths = np.array([len(p[1]) for p in parts])
    letters = [np.diff(starts, append=len(bucket)) for bucket, starts, _, _ in parts]
    scores = [_scores(model, *p[:2], p[3]) for p in parts]
    labels = viterbi(np.concatenate([s for s, _ in scores]), lengths) if len(parts) else np.zeros(0, np.int64)
    cuts = np.cumsum(lengths)[:-1]
    return [(a, p[2], n, ~none) for a, p, n, (_, none) in zip(np.split(labels, cuts), parts, letters, scores, strict=True)]


def _predicted(model: Model | None, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            langs, scores, found = [], [], []
            at = 0
            while at < len(texts):
                end, room = at, BLOCK // (2 * len(model.langs) if model else 1)
                while end < len(texts) and (end == at or room > 0):
                    room -= len(texts[end] or "") // 4
                    end += 1
                part = texts[at:end]
                for text, (label, begin, letters, evidence) in zip(part, _label(model, [t or "" for t in part]) if model else [(None,) * 4] * len(part), strict=True):
                    if label is None or not len(label):
                        langs.append("und")
                        scores.append(0.0)
                        found.append([])
                        continue
                    share = np.bincount(label[evidence], weights=letters[evidence], minlength=len(model.langs))
                    top = int(share.argmax()) if share.any() else model.prior
                    langs.append(model.langs[top])
                    scores.append(float(share[top] / letters.sum()))
                    if spans:
                        cut = np.flatnonzero(np.diff(label, prepend=-1))
                        ends = [*begin[cut[1:]].tolist(), len(text)]
                        found.append([{"start": int(begin[c]), "end": e, "lang": model.langs[label[c]]} for c, e in zip(cut, ends, strict=True)])
                    else:
                        found.append([])
                at = end
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))], ["id", "lang_pred", "score", "lang_spans"])

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model | None, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and lang_spans (start, end, lang; in code points) of every row.

    score is the share of the text's letters in words labelled lang_pred. `und` with score 0: a null text, one without
    letters (marks and digits are none), or no model. A text in scripts that no learned language has gets the commonest
    language with score 0. A text of any length is labelled whole, in blocks of words; repeated rows give one row each, rows
    without id too; an empty table gives none; other columns are left out."""
    share_code(spark)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_predicted(model, spans)), "doc_id long, lang_pred string, score double, lang_spans array<struct<start:long,end:long,lang:string>>")


def accepted(spark: SparkSession, docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """The rows of `docs` of one language: its words have at least the share `least` of the letters. Others go. Without a
    model (no row is labelled) only texts without letters go."""
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    share_code(spark)
    names = docs.columns
    predict = _predicted(model, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(names.index("text"))
            (p,) = predict(iter([pa.RecordBatch.from_arrays([pa.array([None] * len(text), pa.int64()), text], ["doc_id", "text"])]))
            yield b.filter(pa.array([lang != "und" and s >= least for lang, s in zip(p.column(1).to_pylist(), p.column(2).to_pylist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the language of every document, and its spans as start:end:lang, comma-joined."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    spans = F.array_join(F.transform("lang_spans", lambda x: F.concat_ws(":", x["start"], x["end"], x["lang"])), ",")
    return identify(spark, docs, fit(spark, docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", spans.alias("lang_spans"))
