"""Language identification with error-correcting output codes.

Each language has a codeword; each bit has a binary classifier over hashed n-grams of the
letters of a text (bytes of its lower-case UTF-8 form, everything else a space).  Decoding
sums, for each codeword, the logistic loss of the classifiers' margins against its bits
and takes the codeword with the least; where the second is nearly as near, the decision is
flagged as ambiguous.

Training sees a bounded, hash-chosen sample of labelled rows (``SAMPLE`` documents, shared
evenly by the languages; of each the whole text and ``SNIPPETS`` short stretches, so that
short texts are known too).  Prediction reads every whole text, in stretches of bounded
size, and needs no shuffle.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any
labelled row everything is ``und``; with one label it is always that label; every label is
learned; a null doc_id is neither trained on nor held out; equal texts get equal results;
an empty table gives an empty result; other columns, whatever their names, are carried
along (``lang_pred``, ``score`` and ``ambiguous`` are replaced).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bounds of training: documents (at least one of each label), stretches of each besides
#: the whole.
SAMPLE, SNIPPETS = 800, 3
#: Texts whose features are held at once: 256 of them are 4 MB.
SLICE = 256
#: Hashed features and the n-grams that make them; bytes of a text handled at once.
DIMENSIONS, GRAMS, STRETCH = 4096, (1, 2, 3, 4), 1 << 20
#: Ambiguous: the second codeword's mean loss for each bit exceeds the first's by less.
MARGIN = 0.05

_LETTERS = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts of the whole text, of length one."""
    counts = np.zeros(DIMENSIONS)
    raw = f" {text} ".lower().encode("utf-8", "surrogatepass")
    for at in range(0, len(raw), STRETCH):
        b = _LETTERS[np.frombuffer(raw[at : at + STRETCH + max(GRAMS) - 1], np.uint8)]
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint32)
        code = np.zeros(len(b), np.uint32)
        for n in range(1, max(GRAMS) + 1):
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(n)
            counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-9)).astype(np.float32)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """Rows of +-1.  Up to six classes get the exhaustive code; more get the one of 200
    seeded draws of 31 columns whose nearest rows are farthest apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 6:
        rest = [np.array(x) for x in itertools.product((1, -1), repeat=classes - 1)][1:]
        return np.vstack([np.ones(len(rest)), np.array(rest).T])
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (classes, 31))
        agreed = code @ code.T  # 31 less twice the distance
        gap = int((31 - agreed[np.triu_indices(classes, 1)].max()) // 2)
        if gap > apart:
            best, apart = code, gap
    return best


@dataclass
class Model:
    """Languages, their codewords, and the weights and offsets of the bits' classifiers."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each row of features."""
        if len(self.languages) == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool)
        margins = x @ self.weights + self.offsets
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).mean(2)
        order = np.sort(loss, 1)
        weight = np.exp(-(loss - order[:, :1]) * self.code.shape[1])
        return loss.argmin(1), 1 / weight.sum(1), order[:, 1] - order[:, 0] < MARGIN


def fit(x: np.ndarray, labels: list[str], steps: int = 150, decay: float = 1e-5) -> Model:
    """Logistic regression of every bit at once, by accelerated gradient steps."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]].astype(np.float32)
    share = np.array([1 / labels.count(v) for v in languages], np.float32)[[languages.index(v) for v in labels]]
    share = (share / share.sum())[:, None]
    w = v = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    for n in range(steps):
        gradient = x1.T @ (-y * share / (1 + np.exp(np.clip(y * (x1 @ v), -30, 30)))) + decay * v
        step = v - 2.0 * gradient
        v, w = step + n / (n + 3) * (step - w), step
    return Model(languages, code, w[:-1], w[-1])


def held_out(identity: str = "doc_id") -> Column:
    """The fold that is never trained on: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(identity).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, seed: int = 3) -> Model | None:
    """Fit on a sample of the labelled rows outside the held-out fold."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, SAMPLE // len(counts))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    most = F.create_map(*itertools.chain(*((F.lit(k), F.lit(int(min(1.0, each / n) * (1 << 30)))) for k, n in counts.items())))
    chosen = usable.select("lang", draw.alias("draw"), "text").where((F.col("text").isNotNull()) & (F.col("draw") < most[F.col("lang")]))

    def sample(batches):
        for batch in batches:
            out = []
            for lang, draw_, text in zip(batch["lang"], batch["draw"], batch["text"], strict=True):
                rng = np.random.default_rng(int(draw_))
                parts = [text]
                for _ in range(SNIPPETS):
                    at = int(rng.integers(0, max(1, len(text) - 8)))
                    parts.append(text[at : at + int(rng.integers(12, 160))])
                out += [(lang, int(draw_), n, features(p).astype(np.float16).tobytes()) for n, p in enumerate(parts) if any(map(str.isalpha, p))]
            yield pd.DataFrame(out, columns=["lang", "draw", "n", "x"])

    def learn(batches):
        rows = sorted(r for batch in batches for r in batch.itertuples(index=False, name=None))
        kept, seen = [], {}
        for lang, draw_, _, x in rows:  # the draw is close to its bound; the bound is kept exactly
            group = seen.setdefault(lang, {})
            group.setdefault(draw_, len(group))
            if group[draw_] < each:
                kept.append((lang, x))
        del rows
        if kept:
            model = fit(np.stack([np.frombuffer(x, np.float16) for _, x in kept]).astype(np.float32), [lang for lang, _ in kept])
            parts = [a.astype(np.float64).tobytes() for a in (model.code, model.weights, model.offsets)]
            yield pd.DataFrame([(model.languages, *parts)], columns=["languages", "code", "weights", "offsets"])

    # the sample is bounded, so one task learns from it; the driver gets the model alone
    sampled = chosen.mapInPandas(sample, "lang string, draw long, n int, x binary").repartition(1)
    found = sampled.mapInPandas(learn, "languages array<string>, code binary, weights binary, offsets binary").collect()
    if not found:
        return None
    languages = list(found[0].languages)
    code, weights, offsets = (np.frombuffer(bytes(a), np.float64) for a in found[0][1:])
    code = code.reshape(len(languages), -1)
    return Model(languages, code, weights.reshape(DIMENSIONS, -1).astype(np.float32), offsets.astype(np.float32))


def classify(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """``keep`` columns with lang_pred, score and ambiguous for every row."""
    made = ("lang_pred", "score", "ambiguous")
    carried = [c for c in keep if c not in made]
    kept = [F.col(f"_row.`{c}`") for c in carried]
    # a struct keeps other columns' names apart; a struct needs a field
    row = F.struct(*[F.col(f"`{c}`") for c in carried], F.lit(None).alias("_no_column_"))
    lettered = docs.select(row.alias("_row"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_t"))
    if model is None:
        return lettered.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))

    def decoded(texts: pd.Series) -> pd.DataFrame:
        x = np.zeros((len(texts), DIMENSIONS), np.float32)
        for row, text in zip(x, texts, strict=True):
            if text is not None:
                row[:] = features(text)
        best, score, ambiguous = model.decode(x)
        none = texts.isna().to_numpy()
        names = np.array(model.languages, object)[best]
        return pd.DataFrame({"lang_pred": np.where(none, "und", names), "score": np.where(none, 0.0, score), "ambiguous": np.where(none, False, ambiguous)})

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        # a batch may be long: only a slice's features are held at a time
        parts = [decoded(texts.iloc[at : at + SLICE]) for at in range(0, len(texts), SLICE)]
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in made})

    return lettered.withColumn("_p", predict("_t")).select(*kept, *[f"_p.{c}" for c in made])
