"""Quality rules: lines are labelled content or boilerplate by a linear-chain CRF.

Every line with a word becomes a set of shape features. A two-label linear-chain
conditional random field, fitted here by gradient ascent on the exact
log-likelihood, is decoded by Viterbi over the whole text; a document is kept
if at least half of its word bytes lie in content lines.

Training: a bounded sample of labelled rows, TRAINING_DOCS documents of each
quality in the order of a hash of their id and the first TRAINING_LINES lines of
each. A line's label comes from its own signs of boilerplate (SIGNS: symbols,
bars, capitals, repetition), so that labels change within a text and the chain
learns how long either kind runs. The document's label is the judge of the
signs: where most of a good document shows signs, or most of a bad one shows
none, the signs are wrong there and all its lines get the document's label.
Without labelled rows of both kinds all lines count as content.

Rows: one output row per input row. A null or empty text has no words and
fails the base rule. Repeated rows are judged alike, extra columns are ignored
by judge and kept as they are by keep_good, whatever their names; an empty table
gives an empty result. Ties between labels go to content. Of labelled rows with
one id and several texts, one text is trained on. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, require, small_batches, whole_text

TRAINING_DOCS = 1_500
TRAINING_LINES = 120
MIN_WORDS = 50
CONTENT_SHARE = 0.5
#: Fixed value: characters that the base rule counts as symbols.
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "bias", "symbols 2%", "symbols 8%", "upper 30%", "upper 70%", "marks 3%", "marks 8%", "digits 15%", "bars",
    "distinct words 60%", "distinct words 30%", "same word twice running 20%", "under 3 words", "under 8 words", "over 15 words",
    "sentence end", "starts upper", "repeats a line", "long words", "first line", "last line",
)


#: Features that say boilerplate by themselves.
SIGNS = ("symbols 8%", "upper 70%", "marks 8%", "bars", "distinct words 30%", "same word twice running 20%", "repeats a line")
_UPPER, _LETTERS = (bytes(c for c in range(128) if test(chr(c))) for test in (str.isupper, str.isalpha))
_WIDE = re.compile(r"[^\x00-\x7f]")


def _letters(line: str) -> tuple[int, int]:
    """How many letters a line has, and how many capitals."""
    data = line.encode("ascii", "ignore")
    letters, upper = (len(data) - len(data.translate(None, x)) for x in (_LETTERS, _UPPER))
    if len(data) < len(line):
        wide = _WIDE.findall(line)
        letters, upper = letters + sum(map(str.isalpha, wide)), upper + sum(map(str.isupper, wide))
    return letters, upper


def line_features(lines: list[str], words: list[list[bytes]]) -> np.ndarray:
    """A 0/1 row of FEATURES for each line; words: the words of each."""
    seen: set[str] = set()
    rows = []
    for n, (line, own) in enumerate(zip(lines, words, strict=True)):
        size, count = len(line), len(own)
        symbols = sum(map(line.count, SYMBOLS)) / size
        letters, upper = _letters(line)
        upper /= max(1, letters)
        marks = (line.count("!") + line.count("?")) / size
        digits = sum(map(line.count, "0123456789")) / size
        kinds = len(set(own)) / count
        running = sum(a == b for a, b in zip(own, own[1:], strict=False)) / count
        rows.append((
            1, symbols > 0.02, symbols > 0.08, upper > 0.3, upper > 0.7, marks > 0.03, marks > 0.08, digits > 0.15, "|" in line,
            count > 5 and kinds < 0.6, count > 5 and kinds < 0.3, running > 0.2, count < 3, count < 8, count > 15,
            line.rstrip()[-1:] in ".!?:;\"'", line[:1].isupper(), line in seen, size > 14 * count, n == 0, n == len(lines) - 1,
        ))
        seen.add(line)
    return np.array(rows, np.float64).reshape(len(rows), len(FEATURES))


def line_labels(rows: np.ndarray, size: np.ndarray, quality: int) -> np.ndarray:
    """1 for content, 0 for boilerplate, of the lines of a labelled document; size: the weight of each line."""
    plain = ~rows[:, [FEATURES.index(x) for x in SIGNS]].astype(bool).any(1)
    agrees = (2 * size[plain].sum() >= size.sum()) == bool(quality)
    return plain.astype(np.int8) if agrees else np.full(len(rows), quality, np.int8)


class Chain:
    """Linear-chain CRF with labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, state: np.ndarray, step: np.ndarray):
        self.state, self.step = state, step  # (features, 2), (2, 2)

    @classmethod
    def fit(cls, texts: list[np.ndarray], labels: list[np.ndarray], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Chain:
        """Gradient ascent on the mean log-likelihood of the lines; all texts in step, padded. labels: of the lines of each text."""
        model = cls(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
        if len({k for own in labels for k in own.tolist()}) < 2:
            model.state[0, 1] = 1.0
            return model
        longest = max(map(len, texts))
        x = np.zeros((len(texts), longest, len(FEATURES)))
        live = np.zeros((len(texts), longest), bool)
        y = np.zeros((len(texts), longest), np.int64)
        for n, (rows, own) in enumerate(zip(texts, labels, strict=True)):
            x[n, : len(rows)], live[n, : len(rows)], y[n, : len(rows)] = rows, True, own
        # Both labels weigh the same, however many lines have them.
        weight = np.where(y == 1, 0.5 / (live & (y == 1)).sum(), 0.5 / (live & (y == 0)).sum()) * live
        one = np.eye(2)[y]
        speed_state, speed_step = np.zeros_like(model.state), np.zeros_like(model.step)
        for _ in range(rounds):
            score = x @ model.state
            edge = np.exp(model.step)
            ahead, back, scale = np.zeros_like(score), np.ones_like(score), np.ones((len(texts), longest))
            local = np.exp(score - score.max(2, keepdims=True))
            for t in range(longest):
                a = local[:, t] if t == 0 else (ahead[:, t - 1] @ edge) * local[:, t]
                a = np.where(live[:, t, None], a, 0.5)
                scale[:, t] = a.sum(1)
                ahead[:, t] = a / scale[:, t, None]
            for t in range(longest - 2, -1, -1):
                b = (back[:, t + 1] * local[:, t + 1]) @ edge.T
                back[:, t] = np.where(live[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
            belief = ahead * back
            belief /= belief.sum(2, keepdims=True)
            gap = (one - belief) * weight[:, :, None]
            grad_state = np.einsum("ntf,ntk->fk", x, gap) - decay * model.state
            grad_step = -decay * model.step
            if longest > 1:
                pair = ahead[:, :-1, :, None] * edge * (back[:, 1:] * local[:, 1:])[:, :, None, :]
                pair /= pair.sum((2, 3), keepdims=True)
                both = weight[:, 1:]
                grad_step += np.einsum("nt,nti,ntj->ij", both, one[:, :-1], one[:, 1:]) - np.einsum("nt,ntij->ij", both, pair)
            speed_state, speed_step = 0.9 * speed_state + grad_state, 0.9 * speed_step + grad_step
            model.state += rate * speed_state
            model.step += rate * speed_step
        return model

    def decode(self, rows: np.ndarray) -> np.ndarray:
        """The best label of each line (Viterbi); ties go to content."""
        score = (rows @ self.state).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        bad, good = score[0]
        came: list[tuple[int, int]] = []
        for a, b in score[1:]:
            to_bad = (0, bad + s00) if bad + s00 > good + s10 else (1, good + s10)
            to_good = (0, bad + s01) if bad + s01 > good + s11 else (1, good + s11)
            came.append((to_bad[0], to_good[0]))
            bad, good = a + to_bad[1], b + to_good[1]
        best = [int(good >= bad)]
        for step in reversed(came):
            best.append(step[best[-1]])
        return np.array(best[::-1], np.int8)


def _lines(text: str) -> tuple[list[str], list[list[bytes]]]:
    """The \\n-split lines that hold a word, and the words of each."""
    lines, words = [], []
    for line in text.split("\n"):
        if own := line.encode().split():
            lines.append(line)
            words.append(own)
    return lines, words


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.encode().split()  # bytes.split() cuts at ASCII white space alone
    n = len(words)
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)] if "\n" in text else []
    again = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], np.int64)
        if len(ids) < n:
            _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
            window = pair[:-1].astype(np.int64) * len(ids) + w[2:]
            _, at, count = np.unique(window, return_inverse=True, return_counts=True)
            starts = np.flatnonzero(count[at] > 1)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[starts + k] = True
            again = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), again


def fit_chain(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> Chain:
    """Fit on at most training_docs labelled documents of each kind."""
    require(labels, "doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for quality, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, words = _lines(text)
                lines, words = lines[:TRAINING_LINES], words[:TRAINING_LINES]
                rows = line_features(lines, words).astype(np.int8)
                own = line_labels(rows, _sizes(words), quality)
                out.append(np.concatenate([own[:, None], rows], 1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "rows"])

    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    picked = None
    for kind in (0, 1):
        some = marked.where(F.col("quality") == kind).orderBy(order, "doc_id").limit(training_docs)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * training_docs ids, whatever the tables' size.
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = small_batches(texts).select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(run, f"doc_id {kind}, rows binary")
    # One text for each id reaches the driver. Sorted, so that the fitted sums are the same in every run.
    found = found.groupBy("doc_id").agg(F.min("rows").alias("rows")).where("length(rows) > 0").toPandas()
    both = [np.frombuffer(r, np.int8).reshape(-1, 1 + len(FEATURES)) for r in sorted(map(bytes, found["rows"]))]
    return Chain.fit([x[:, 1:].astype(np.float64) for x in both], [x[:, 0] for x in both])


def _sizes(words: list[list[bytes]]) -> np.ndarray:
    return np.array([sum(map(len, own)) for own in words], np.float64)


def verdict(text: str, model: Chain, content_share: float = CONTENT_SHARE) -> tuple[tuple[int, ...], bool, float, bool]:
    """Base counts, base_failed, the share of word bytes in content lines, kept."""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
    lines, words = _lines(text)
    if not lines:
        return counts, failed, 0.0, False
    size = _sizes(words)
    share = float((model.decode(line_features(lines, words)) * size).sum() / size.sum())
    return counts, failed, share, not failed and share >= content_share


def judge(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, base counts, base_failed, content_share, kept) of every document."""
    require(docs, "doc_id", "text")
    state, step = chain.state, chain.step
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(state, step)
        for batch in batches:
            found = [verdict(x.as_py(), model, content_share) for x in batch.column(1)]
            counts = [pa.array([x[0][k] for x in found], pa.int64()) for k in range(5)]
            rest = [pa.array([x[k] for x in found], kind) for k, kind in ((1, pa.bool_()), (2, pa.float64()), (3, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *rest], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"
    return small_batches(docs).select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that pass, with all their own columns; one pass, no join."""
    require(docs, "text")
    state, step = chain.state, chain.step
    at = docs.columns.index("text")

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(state, step)
        for batch in batches:
            good = batch.filter(pa.array([verdict(x.as_py() or "", model, content_share)[3] for x in batch.column(at)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(good.columns, names)

    # Columns are known by their places: names may be such as have to be quoted.
    return small_batches(docs).toDF(*[f"c{n}" for n in range(len(names))]).mapInArrow(run, docs.schema)
