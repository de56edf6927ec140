"""Language identification by interpolated Kneser-Ney character models.

Words (runs of letters, lower-cased) are padded with begin and end marks, and
each language has a character model of `ORDER`-grams over them. Probabilities
of all languages sit side by side in arrays sorted by the hash of the n-gram, so
one binary search serves every language; n-grams that no language has seen are
scored through the back-off weights of their contexts. A text gets the language
of the lowest cross-entropy per character, and is rejected where even that is
above what all but a stated share of known texts of its language and length have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_workers, materialise, release
from .tokens import slices

ORDER = 4
#: Expected number of training texts for each language; the sample is drawn by a hash of doc_id and text.
TRAIN_DOCS = 1500
#: Expected number of texts for each language that set the rejection bounds.
CALIBRATION_DOCS = 600
#: Expected bytes of either sample for each language at most; where texts are long, fewer are drawn.
SAMPLE_BYTES = 64 << 20
#: Distinct words of a language that it is trained on; where a sample has more, they are drawn by hash.
MOST_WORDS = 200_000
#: Up to so many languages have the numbers above; more share what these would have, with `LEAST` texts each at least.
FULL_LANGS = 256
LEAST = 32
#: Texts are kept from training only where a language has as many others.
ENOUGH = 10
#: Languages whose scores sit side by side; more are trained and scored group by group.
GROUP = 32
#: A text is rejected if its cross-entropy exceeds this quantile of calibration texts with its prediction
#: and length by `MARGIN` (nats a character) and, as the mean of n characters spreads like 1 / sqrt(n),
#: by `SPREAD` / sqrt(n) more: at most 1 - QUANTILE of known texts are rejected.
QUANTILE = 0.99
MARGIN = 0.5
SPREAD = 4.0
#: Length classes are powers of two, the last open.
CLASSES = 13
#: Evidence beyond so many characters no longer sharpens a score.
SHARPEST = 40.0
NONE = "und"
#: Name of the text column on the way to the workers.
BODY = "_text_to_identify_"
_PAD, _END, _OTHER = 1, 2, 3
#: Texts are folded in slices of so many bytes.
SLICE = 2 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one 64-bit hash, so the packed n-grams cannot collide."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(texts: pa.Array) -> pa.Array:
    """Lists of words: lower-cased runs of letters; the first and last item of a list may be empty."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"\PL+", " ")
    return pc.split_pattern(plain, " ")


@dataclass
class Model:
    """langs; a code per character; per order k the sorted hashes of its k-grams and, per language,
    the interpolated log probability of the last character and the log back-off weight of the k-gram as context;
    the log probability of the uniform distribution and of a character that was never seen;
    the highest accepted cross-entropy of every language (of all groups) and length class."""

    langs: list[str]
    alphabet: np.ndarray
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    uniform: np.ndarray
    unseen: np.ndarray
    limits: np.ndarray | None = None
    #: Models of further groups of languages, over the same alphabet.
    more: list[Model] = field(default_factory=list)

    @property
    def every(self) -> list[str]:
        """The languages of all groups."""
        return [x for m in (self, *self.more) for x in m.langs]

    @property
    def order(self) -> int:
        return len(self.hashes)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character codes of padded words laid end to end, and the length of each with its end mark."""
        pads = self.order - 1
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        lens = np.fromiter(map(len, words), np.int64, len(words))
        at = np.searchsorted(self.alphabet, flat)
        at[at == len(self.alphabet)] = 0
        code = np.where(self.alphabet[at] == flat, at + _OTHER + 1, _OTHER) if len(self.alphabet) else np.full(len(flat), _OTHER)
        out = np.full(len(flat) + len(words) * (pads + 1), _PAD, np.uint64)
        ends = np.cumsum(lens + pads + 1)
        out[np.arange(len(flat)) + np.repeat((np.arange(len(words)) + 1) * pads + np.arange(len(words)), lens)] = code
        if len(words):
            out[ends - 1] = _END
        return out, lens + 1

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word under each language, scored characters of each word)."""
        codes, lens = self.codes(words)
        grams = _grams(codes, lens, self.order)
        scores = self._score(grams, self.order)
        bounds = np.cumsum(lens) - lens
        return np.add.reduceat(scores, bounds, axis=0) if len(words) else np.zeros((0, len(self.langs))), lens

    def _score(self, grams: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.broadcast_to(self.uniform, (len(grams), len(self.langs)))
        at, seen = _find(self.hashes[k - 1], grams)
        out = self.logp[k - 1][at]
        if not seen.all():
            missing = ~seen
            rest = grams[missing]
            if k == 1:
                lower = self.unseen
            else:
                lower = self._score(rest & _keep(k - 1), k - 1).copy()
                here, known = _find(self.hashes[k - 2], rest >> np.uint64(16))
                lower += np.where(known[:, None], self.backoff[k - 2][here], 0.0)
            out[missing] = lower
        return out


def _keep(k: int) -> np.uint64:
    return np.uint64((1 << 16 * k) - 1)


def _find(table: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = _mix(grams)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(grams), bool)


def _grams(codes: np.ndarray, lens: np.ndarray, order: int) -> np.ndarray:
    """The `order` codes that end at each scored character, packed 16 bits each."""
    packed = np.zeros(len(codes), np.uint64)
    for back in range(order):
        packed[back:] |= codes[: len(codes) - back] << np.uint64(16 * back)
    scored = np.ones(len(codes), bool)
    starts = np.cumsum(lens + order - 1) - (lens + order - 1)
    for i in range(order - 1):
        scored[starts + i] = False
    return packed[scored]


def _alphabet(counts: dict[str, tuple[list[str], np.ndarray]]) -> np.ndarray:
    chars, n = np.unique(np.concatenate([np.frombuffer("".join(w).encode("utf-32-le"), "<u4") for w, _ in counts.values()] or [np.empty(0, "<u4")]), return_counts=True)
    return np.sort(chars[np.argsort(-n, kind="stable")[: (1 << 16) - _OTHER - 2]])


def train(counts: dict[str, tuple[list[str], np.ndarray]], order: int = ORDER) -> Model:
    """Fit a model to {language: (distinct words, their counts)}, with further groups of `GROUP` languages in `more`."""
    chars, langs = _alphabet(counts), sorted(counts)
    first, *more = [_train({x: counts[x] for x in langs[at : at + GROUP]}, order, chars) for at in range(0, max(len(langs), 1), GROUP)]
    first.more = more
    return first


def _train(counts: dict[str, tuple[list[str], np.ndarray]], order: int, chars: np.ndarray) -> Model:
    """A model of one group.

    The highest order discounts raw counts, lower ones the number of distinct
    characters before an n-gram; what the discount frees goes to the next lower
    order, and below single characters to a uniform distribution.
    """
    langs = sorted(counts)
    model = Model(langs, chars, [np.empty(0, np.uint64)] * order, [np.zeros((1, len(langs)))] * order, [np.zeros((1, len(langs)))] * order, np.zeros(len(langs)), np.zeros(len(langs)))
    if not langs:
        return model
    tables: list[list[dict]] = []
    for lang in langs:
        words, freq = counts[lang]
        codes, lens = model.codes(words)
        grams = _grams(codes, lens, order)
        uniq, back = np.unique(grams, return_inverse=True)
        tables.append(_kneser_ney(uniq, np.bincount(back, np.repeat(freq, lens), len(uniq)), order, len(chars) + 2))
    for k in range(1, order + 1):
        keys = np.unique(np.concatenate([t[k - 1]["grams"] for t in tables] + [t[k]["contexts"] for t in tables if k < order]))
        model.hashes[k - 1] = keys[np.argsort(_mix(keys))]
        model.backoff[k - 1] = np.zeros((len(keys), len(langs)))
    model.uniform = np.full(len(langs), -np.log(len(chars) + 2))
    model.unseen = model.uniform + np.array([t[0]["free"][0] for t in tables])
    sorted_keys = [g.copy() for g in model.hashes]
    model.hashes = [_mix(g) for g in model.hashes]
    for k in range(1, order + 1):
        if k < order:
            for i, t in enumerate(tables):
                at, ok = _find(model.hashes[k - 1], t[k]["contexts"])
                model.backoff[k - 1][at[ok], i] = t[k]["free"][ok]
    for k in range(1, order + 1):
        keys = sorted_keys[k - 1]
        lower = np.array(model._score(keys & _keep(k - 1), k - 1), copy=True)
        out = np.empty_like(lower)
        for i, t in enumerate(tables):
            level = t[k - 1]
            free = _lookup(level["contexts"], level["free"], keys >> np.uint64(16), 0.0)
            direct = _lookup(level["grams"], level["share"], keys, 0.0)
            out[:, i] = np.log(direct + np.exp(free + lower[:, i]))
        model.logp[k - 1] = out
    return model


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _kneser_ney(grams: np.ndarray, counts: np.ndarray, order: int, symbols: int) -> list[dict]:
    """Per order: its n-grams with their discounted share, and its contexts with the log of the freed mass."""
    out = []
    for k in range(order, 0, -1):
        context, back = np.unique(grams >> np.uint64(16), return_inverse=True)
        total = np.bincount(back, counts, len(context))
        kinds = np.bincount(back, minlength=len(context))
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        out.append({"grams": grams, "share": (counts - discount) / total[back], "contexts": context, "free": np.log(discount * kinds / total)})
        if k > 1:
            # The next lower order counts the distinct characters that come before.
            grams, n = np.unique(grams & _keep(k - 1), return_counts=True)
            counts = n.astype(float)
    return out[::-1]


def scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each text under each language, scored characters); a text without letters has 0 characters."""
    words = letters(pc.fill_null(texts, ""))
    per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    blank = np.array([not w for w in distinct], bool)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    starts = np.cumsum(per) - per  # a list has one item at least
    if not len(per):
        return np.zeros((0, len(model.every))), np.zeros(0, np.int64)
    by_text = []
    for group in (model, *model.more):
        by_word, lens = group.word_scores(distinct)
        by_word[blank], lens = 0.0, np.where(blank, 0, lens)
        by_text.append(np.add.reduceat(by_word[codes], starts, axis=0))
    return np.concatenate(by_text, axis=1) if model.more else by_text[0], np.add.reduceat(lens[codes], starts)


def _length_class(chars: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(chars, 1)).astype(int), CLASSES - 1)


def limits(seen: dict[tuple[int, int], float], langs: int) -> np.ndarray:
    """Bounds for all languages and length classes from the quantiles seen, {(language, class): entropy},
    with the margins of the class's shortest texts.

    A class that has none takes that of the nearest shorter class, whose texts vary more; below the
    shortest class seen, each halving of the length allows another MARGIN. A language that has none
    at all takes the greatest bound of the others, and without any bound nothing is rejected.
    """
    out = np.full((langs, CLASSES), np.nan)
    for (lang, at), entropy in seen.items():
        out[lang, at] = entropy + MARGIN + SPREAD / 2 ** (at / 2)
    for row in out:
        known = np.flatnonzero(~np.isnan(row))
        for at in range(CLASSES) if len(known) else ():
            before = known[known <= at]
            row[at] = row[before[-1]] if len(before) else row[known[0]] + MARGIN * (known[0] - at)
    most = np.where(np.isnan(out), -np.inf, out).max(0, initial=-np.inf)
    return np.where(np.isnan(out), np.where(np.isinf(most), np.inf, most), out)


def _entropies(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["text"], SLICE):
                score, chars = scores(model.value, batch["text"].slice(at, to - at))
                some = chars > 0
                best, chars = score[some].argmax(1), chars[some]
                columns = [best, _length_class(chars), -score[some].max(1) / chars]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "class", "entropy"])
        release()

    return run


def calibrate(model: Model, sample: DataFrame) -> None:
    """Set the bounds from the texts of a sample. Entropies are computed and their quantiles taken on
    the executors; one number for each language and length class comes back."""
    if not model.langs:
        return
    held = sample.sparkSession.sparkContext.broadcast(model)
    found = sample.select("text").mapInArrow(_entropies(held), "lang long, class long, entropy double")
    seen = found.groupBy("lang", "class").agg(F.percentile("entropy", F.lit(QUANTILE)).alias("q")).collect()
    model.limits = limits({(r["lang"], r["class"]): r["q"] for r in seen}, len(model.every))


def predict(model: Model, texts: pa.Array) -> dict[str, np.ndarray]:
    score, chars = scores(model, texts)
    if not model.langs:
        return {"lang_pred": np.full(len(chars), NONE, object), "score": np.zeros(len(chars)), "entropy": np.full(len(chars), np.nan), "rejected": np.ones(len(chars), bool)}
    some = chars > 0
    per = score / np.maximum(chars, 1)[:, None]
    best = per.argmax(1)
    top = per[np.arange(len(per)), best]
    weight = np.minimum(chars, SHARPEST)[:, None]
    sure = 1.0 / np.exp(np.maximum((per - top[:, None]) * weight, -700)).sum(1)
    over = -top > model.limits[best, _length_class(chars)]
    return {
        "lang_pred": np.where(some, np.array(model.every, object)[best], NONE),
        "score": np.where(some, sure, 0.0),
        "entropy": np.where(some, -top, np.nan),
        "rejected": ~some | over,
    }


def _draw(labelled: DataFrame, rates: dict[str, float], salt: str) -> DataFrame:
    """A sample by hash at the rate of each language; others give no text, and repeated rows one."""
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    table = pa.table({"lang": pa.array(list(rates), pa.string()), "rate": pa.array(list(rates.values()), pa.float64())})
    # One row a language.
    drawn = labelled.join(F.broadcast(labelled.sparkSession.createDataFrame(table)), "lang").filter(draw < F.col("rate"))
    return drawn.groupBy("lang", F.xxhash64("doc_id", "text").alias("unit")).agg(F.first("text").alias("text")).select("lang", "text")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to in slices(batch["text"], SLICE):
            lists = letters(batch["text"].slice(at, to - at))
            lang = batch["lang"].slice(at, to - at).take(pc.list_parent_indices(lists))
            table = pa.table({"lang": lang, "word": lists.flatten()}).group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from table.rename_columns(["lang", "word", "n"]).to_batches()


def _counted(sample: DataFrame, most: int) -> dict[str, tuple[list[str], np.ndarray]]:
    """{language: (distinct words, their counts)} of sampled texts, about `most` words a language."""
    counts = sample.mapInArrow(_words, "lang string, word string, n long").filter("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "language-words")
    many = {r["lang"]: most / r["count"] for r in counts.groupBy("lang").count().filter(F.col("count") > most).collect()}
    if many:
        rate = F.element_at(F.create_map(*[F.lit(x) for pair in many.items() for x in pair]), F.col("lang"))
        draw = F.pmod(F.xxhash64("word"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        counts = counts.filter(rate.isNull() | (draw < rate))
    table = counts.orderBy("lang", "word").toArrow()
    by = {}
    at = 0
    for run in pc.run_end_encode(table["lang"].combine_chunks()).run_ends.to_pylist() if len(table) else []:
        rows = table.slice(at, run - at)
        by[rows["lang"][0].as_py()] = (rows["word"].to_pylist(), rows["n"].to_numpy().astype(float))
        at = run
    return by


def fit(docs: DataFrame, chosen: Column | None = None, *, order: int = ORDER, train_docs: int = TRAIN_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Train on the rows of `docs` (doc_id, text, lang) with text and lang for which `chosen` holds.

    About `train_docs` whole texts for each language are drawn by a hash of doc_id and text, and
    about `calibration_docs` others set the rejection bounds (none of a language with fewer than
    ENOUGH texts beside them, which is trained on all). Rows equal in doc_id, text and lang count
    once. Beyond FULL_LANGS languages each gets fewer texts and words, so what the driver receives
    (distinct words with counts, and a bound for each language and length class) is bounded at any
    corpus size. Every language with a text with letters is learned. Without labelled rows the model
    has none and every text is `und`.
    """
    if order > 4:
        raise ValueError("n-grams of at most four characters are packed")
    ensure_workers(docs.sparkSession)
    some = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.lit(True) if chosen is None else chosen))
    some = some.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # Texts that calibrate are not trained on.
    half = F.pmod(F.xxhash64("doc_id", "text", F.lit("part")), F.lit(5)) == 0
    unit = F.xxhash64("doc_id", "text")
    sized = some.groupBy("lang").agg(
        F.approx_count_distinct(unit).alias("n"),
        F.approx_count_distinct(F.when(~half, unit)).alias("others"),
        F.avg(F.octet_length("text")).alias("bytes"),
    )
    counted = {r["lang"]: r for r in sized.collect()}
    part = min(1.0, FULL_LANGS / max(len(counted), 1))
    room = {x: SAMPLE_BYTES * part / max(r["bytes"], 1.0) for x, r in counted.items()}

    def rates(langs: list[str], wanted: int, scale: float) -> dict[str, float]:
        return {x: scale * min(max(wanted * part, min(wanted, LEAST)), max(room[x], 1.0)) / counted[x]["n"] for x in langs}

    parted = [x for x, r in counted.items() if r["others"] >= ENOUGH]
    few = [x for x in counted if x not in set(parted)]
    sample = _draw(some.filter(~half), rates(parted, train_docs, 5 / 4), "train")
    most = max(1000, int(MOST_WORDS * part))
    by = _counted(sample.unionByName(_draw(some, rates(few, train_docs, 1.0), "train")) if few else sample, most)
    missing = {x: 1.0 for x in counted if x not in by}
    if missing:
        # The hash may pass over all texts of a language.
        texts = _draw(some.filter(F.col("text").rlike(r"\p{L}")), missing, "all")
        by |= _counted(texts.groupBy("lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")), most)
    model = train(by, order)
    del by
    release()
    calibrate(model, _draw(some.filter(half), rates(parted, calibration_docs, 5.0), "calibrate"))
    return model


def _predictions(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch[BODY], SLICE):
                found = predict(model.value, batch[BODY].slice(at, to - at))
                kept = [batch.column(i).slice(at, to - at) for i in range(batch.num_columns - 1)]
                extra = [pa.array(found["lang_pred"], pa.string()), pa.array(found["score"]), pa.array(found["entropy"], from_pandas=True), pa.array(found["rejected"])]
                yield pa.RecordBatch.from_arrays([*kept, *extra], names=names)
        release()

    return run


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The `keep` columns with lang_pred, score, entropy and rejected for the whole text of every row.

    A null text or one without letters is `und` with score 0, and rejected. Ties go to the
    language that sorts first. `score` is the posterior of lang_pred under equal priors,
    with the evidence of a long text limited. A text beyond the bound of its language and length
    keeps its lang_pred and is marked rejected. An empty table gives no row.
    """
    spark: SparkSession = docs.sparkSession
    ensure_workers(spark)
    rows = docs.select(*keep, docs["text"].cast("string").alias(BODY))
    schema = ", ".join([*[f"`{c}` {dict(docs.dtypes)[c]}" for c in keep], "lang_pred string, score double, entropy double, rejected boolean"])
    names = [*keep, "lang_pred", "score", "entropy", "rejected"]
    return rows.mapInArrow(_predictions(spark.sparkContext.broadcast(model), names), schema)
