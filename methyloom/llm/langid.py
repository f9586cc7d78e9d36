"""Language of documents and of their passages by Bayesian fusion of several kinds of evidence.

Text: passages (sentences and lines) get the log-likelihood of each language from character n-grams
and words, estimated on a bounded table of labelled samples (``MAX_SAMPLES`` rows at most; readings
of the samples in a wrong charset are added, so that garbled text keeps its language). Address:
languages of all documents are counted per host, per domain, per address suffix and overall by
grouped aggregation, and each level is smoothed with the one above it. Declarations: the language in
the markup and in the response headers counts by how often such declarations agree with the text, a
rate that is also aggregated over all documents. The posterior of a passage combines these with the
share of each language in its own document, which is refined for a few rounds.

The corpus is read once by the text model; what it finds per passage (how far each language lies
behind the likeliest) is written to the shared folder and joined with the priors of its host. Hosts
that hold at least 1/``HOT_SHARE`` of all documents, of which there are at most so many, are joined by
broadcast; documents of the others meet their prior by (host, salt), with as many salts as keep the
documents of one host and salt at ``DOCUMENTS_PER_SALT`` or less.

Defined results: null, empty and letterless texts have no passage and no language; every letter of a
text lies in exactly one passage; repeated documents count each; null hosts share one prior; an
empty table gives no rows. Letters are what Unicode calls so; offsets count characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methyloom.session import checkpointed

MAX_SAMPLES = 20_000
ORDERS = 4
ALPHA = 1.0
_MISREAD = 0.05
_CACHED_TOKENS, _CACHED_CHARS = 200_000, 20_000_000  # a worker forgets beyond these, it skips nothing
HOST_WEIGHT = 5.0  # documents that each level of the address counts as for the level below
CONTEXT = 0.9  # weight of the document's own languages in the prior of its passages
ROUNDS = 4
SURE_LETTERS = 40
TEMPER = 0.7  # evidence of n-grams overlaps, so it counts less than if they were independent
CALIBRATED = 2.0  # the same weight at which confidence agrees with accuracy on held-out samples (measured in the tests)
_FLOOR = 1e-4
_CJK = re.compile("[\u2e80-\u2fff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f]")
_TOKENS = r"\p{L}+(?:[\p{M}\p{Cf}]+\p{L}*)*|\P{L}+"
_END = r"[\n\r\u2028\u2029。！？]|[.!?…][)\]\"'»”’]*(?=\s|$)"
# Charsets in which a page may wrongly be read, and those it may really be in.
_READ_AS = ("cp1252", "latin-1", "cp1251")
_WRITTEN_IN = ("utf-8", "cp1251", "koi8-r", "euc-jp", "shift_jis", "gb18030", "iso-8859-9", "iso-8859-2", "cp1250", "latin-1")


def _grams(token: str) -> list[tuple[int, str]]:
    """(order, n-gram) of a word with its ends marked, and the word as order 0; ideographs and kana stand alone."""
    word = unicodedata.normalize("NFC", "".join(c for c in token.lower() if unicodedata.category(c) != "Cf"))
    grams = [(n, c) for c in _CJK.findall(word) for n in (0, 1)]
    for part in _CJK.split(word):
        if part:
            w = f" {part} "
            grams += [(n, w[i : i + n]) for n in range(1, ORDERS + 1) for i in range(len(w) - n + 1)]
            grams.append((0, part))
    return grams


def _misread(text: str) -> set[str]:
    """The readings of a text in a wrong charset that differ from it."""
    out = set()
    for real in _WRITTEN_IN:
        try:
            raw = text.encode(real)
        except UnicodeEncodeError:
            continue
        out.update(raw.decode(wrong, "replace") for wrong in _READ_AS)
    return out - {text}


class TextModel:
    """Log-likelihoods of words under each language; small, made from the samples alone."""

    def __init__(self, samples: list[tuple[str, str]]):
        import regex

        self.languages = sorted({lang for lang, _ in samples})
        find, k = regex.compile(_TOKENS).findall, len(self.languages)
        tokens: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for lang, text in samples:
            at = self.languages.index(lang)
            # misreadings count little: they fill gaps only
            for weight, reading in [(1.0, text), *((_MISREAD, m) for m in _misread(text))]:
                for token in find(reading):
                    tokens[token][at] += weight
        counts: dict[tuple[int, str], np.ndarray] = defaultdict(lambda: np.zeros(k))
        for token, c in tokens.items():
            if token[0].isalpha():
                for gram in _grams(token):
                    counts[gram] += c
        self.grams = {gram: i for i, gram in enumerate(counts)}
        c = np.array(list(counts.values())).reshape(-1, k)
        order = np.array([n for n, _ in counts], dtype=np.int64)
        self.scores = np.zeros((len(c) + ORDERS + 1, k), np.float32)  # the last rows: what was never seen, by order
        for n in range(ORDERS + 1):
            own = order == n
            total = c[own].sum(axis=0)
            # languages with fewer samples must not look likelier for what none of them has
            level = c[own] * (total.max(initial=1) / np.maximum(total, 1e-9))
            norm = total.max(initial=1) + ALPHA * (own.sum() + 1)
            self.scores[: len(c)][own] = np.log((level + ALPHA) / norm) / (ORDERS + 1)
            self.scores[len(c) + n] = np.log(ALPHA / norm) / (ORDERS + 1)

    def word(self, token: str) -> np.ndarray:
        unseen = len(self.grams)
        rows = [self.grams.get(g, unseen + g[0]) for g in _grams(token)]
        return self.scores[rows].sum(axis=0)


class Reader(dict):
    """Token to its number; likelihoods, letters, characters and kind of a token stand at its number."""

    def __init__(self, model: TextModel):
        import regex

        super().__init__()
        self._model, self._end = model, regex.compile(_END)
        self._find = regex.compile(_TOKENS).findall
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._scores = np.zeros((1024, len(self._model.languages)), np.float32)
        self._facts = np.zeros((1024, 3), np.int64)  # letters, characters, ends a passage
        self._chars = 0

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self._facts):
            self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            self._facts = np.concatenate([self._facts, np.zeros_like(self._facts)])
        if token[0].isalpha():
            self._scores[at] = self._model.word(token)
            self._facts[at] = sum(map(str.isalpha, token)), len(token), 0
        else:
            self._facts[at] = 0, len(token), self._end.search(token) is not None
        self._chars += len(token)
        self[token] = at
        return at

    def passages(self, text: str | None) -> tuple[np.ndarray, ...] | None:
        """(start, end, letters, log-likelihoods) of the passages that have letters."""
        if not text:
            return None
        if len(self) > _CACHED_TOKENS or self._chars > _CACHED_CHARS:
            self._reset()
        ids = np.fromiter(map(self.__getitem__, self._find(text)), np.int64)
        facts = self._facts[ids]
        first = np.concatenate([[0], np.flatnonzero(facts[:, 2]) + 1])
        first = first[first < len(ids)]
        letters = np.add.reduceat(facts[:, 0], first)
        has = letters > 0
        if not has.any():
            return None
        upto = np.cumsum(facts[:, 1])
        start = np.concatenate([[0], upto[first[1:] - 1]])
        stop = np.concatenate([start[1:], upto[-1:]])
        scores = np.add.reduceat(self._scores[ids], first, axis=0)
        return start[has], stop[has], letters[has], scores[has]


def posterior(scores: np.ndarray, letters: np.ndarray, of: np.ndarray, prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posteriors of passages; ``of`` is the document of each, ``prior`` the prior of each document.

    The prior of a passage mixes that of its document with the shares of its document's languages so
    far, in which ``SURE_LETTERS`` letters are discounted per language: one short passage that looks
    foreign is no evidence for a mixed document, clear passages stand on their own likelihood.
    """
    weight = letters[:, None].astype(np.float64)
    mixed = prior
    for _ in range(rounds):
        joint = TEMPER * scores + np.log(mixed[of])
        joint -= joint.max(axis=1, keepdims=True)
        post = np.exp(joint)
        post /= post.sum(axis=1, keepdims=True)
        held = np.zeros_like(prior)
        np.add.at(held, of, post * weight)
        held = np.maximum(held - SURE_LETTERS, 0)
        total = held.sum(axis=1, keepdims=True)
        held = np.where(total > 0, held / np.maximum(total, 1e-9), prior)
        mixed = np.maximum(CONTEXT * held + (1 - CONTEXT) * prior, _FLOOR)
    return post


def confidences(post: np.ndarray) -> np.ndarray:
    """Posteriors as confidences: discounting evidence makes decisions careful, but confidence too low; this gives the weight back."""
    sharp = post ** (CALIBRATED / TEMPER)
    return sharp / sharp.sum(axis=1, keepdims=True)


def text_model(samples: DataFrame, lang: str = "lang", text: str = "sample_text", max_samples: int = MAX_SAMPLES) -> TextModel:
    """The text model of at most ``max_samples`` labelled rows, chosen by a hash if there are more."""
    rows = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    return TextModel([tuple(r) for r in rows.orderBy(F.xxhash64(lang, text), lang, text).limit(max_samples).collect()])


def language_names(codes: DataFrame, limit: int = 1000) -> dict[str, str]:
    """Lower-case code, three-letter code and English name to the code; a fixed small table."""
    rows = codes.select("lang", "alpha3", "name_en").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} languages")
    return {name.lower(): r["lang"] for r in rows if r["lang"] for name in r if name}


def named_language(label: Column, names: dict[str, str]) -> Column:
    """The language a label names: a name, or a code followed by - or _ and a region or script; else null."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    code = F.regexp_extract(plain, r"^([a-z]{2})[-_][a-z0-9]+(?:[-_][a-z0-9]+)*$", 1)
    return F.coalesce(F.try_element_at(known, plain), F.when(code != "", F.try_element_at(known, code)))


def declared_languages(page: Column, headers: Column, names: dict[str, str]) -> dict[str, Column]:
    """The language that the markup and that the response headers declare, each null if none is named."""
    html = F.decode(page, "ISO-8859-1")
    markup = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([^\"'\s>]*)", 1)
    header = F.regexp_extract(headers, r"(?im)^content-language:[ \t]*([^\r\n,;]*)", 1)
    return {"markup": named_language(markup, names), "header": named_language(header, names)}


_PASSAGE = "struct<`from`:int,`to`:int,letters:int,behind:array<float>>"


def _read_texts(model):
    """Per document its passages, each with how far every language lies behind the likeliest."""

    def run(batches):
        reader = Reader(model.value)
        k = len(model.value.languages)
        for batch in batches:
            counts, found = np.zeros(batch.num_rows + 1, np.int32), []
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                passages = reader.passages(text.as_py())
                if passages is not None:
                    found.append(passages)
                    counts[i + 1] = len(passages[0])
            start, stop, letters, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3 + (np.empty((0, k)),)
            behind = (scores.max(axis=1, keepdims=True) - scores).astype(np.float32)
            fields = [pa.array(x.astype(np.int32)) for x in (start, stop, letters)]
            fields.append(pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * k), pa.array(behind.ravel())))
            names = ["from", "to", "letters", "behind"]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.StructArray.from_arrays(fields, names))
            # the language of most letters, by the text alone
            of = np.repeat(np.arange(batch.num_rows), counts[1:])
            held = np.zeros((batch.num_rows, k))
            np.add.at(held, (of, behind.argmin(axis=1)), letters)
            main = pa.array(held.argmax(axis=1).astype(np.int8), mask=counts[1:] == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], main, lists], names=[*batch.schema.names[:-1], "main", "passages"])

    return run


def _fuse(languages: list[str], rates: dict[str, float]):
    """Per document its passages with language and confidence; neighbours of one language are one passage."""
    k = len(languages)
    index = {lang: i for i, lang in enumerate(languages)}

    def declared(column: pa.Array, rate: float) -> np.ndarray:
        at = np.array([index.get(x, -1) for x in column.to_pylist()], dtype=np.int64)
        factor = np.where(np.arange(k) == at[:, None], rate, (1 - rate) / max(k - 1, 1))
        return np.where(at[:, None] >= 0, factor, 1.0)

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            prior = np.array(column["prior"].to_pylist(), dtype=np.float64).reshape(n, k)
            for channel, rate in rates.items():
                prior *= declared(column[channel], rate)
            prior /= prior.sum(axis=1, keepdims=True)
            lists = column["passages"]
            counts = lists.value_lengths().fill_null(0).to_numpy()
            items = lists.flatten()
            get = lambda name: items.field(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            letters, of = get("letters"), np.repeat(np.arange(n), counts)
            scores = -items.field("behind").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k)
            post = posterior(scores, letters, of, prior)
            best = post.argmax(axis=1) if len(post) else np.empty(0, np.int64)
            sure = confidences(post)[np.arange(len(best)), best] * letters
            new = np.ones(len(best), bool)
            new[1:] = (best[1:] != best[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(letters, first) if len(first) else np.empty(0, np.int64)
            last = np.r_[first[1:], len(best)][: len(first)] - 1  # none in a batch without passages
            confidence = np.add.reduceat(sure, first) / total if len(first) else np.empty(0)
            out = pa.StructArray.from_arrays(
                [pa.array(get("from")[first]), pa.array(get("to")[last].astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(languages).take(pa.array(best[first])), pa.array(confidence)],
                ["from", "to", "letters", "lang", "confidence"],
            )
            ends = np.r_[0, np.cumsum(np.bincount(of[first], minlength=n))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(column[c] for c in ("key", "label")), pa.ListArray.from_arrays(pa.array(ends), out)], names=["key", "label", "passages"])

    return run


def host_priors(read: DataFrame, k: int) -> DataFrame:
    """(host, n_host, n_all, prior): languages per host, smoothed with its domain, suffix and all documents."""
    per = [F.sum((F.col("main") == i).cast("double")).alias(f"c{i}") for i in range(k)]
    add = lambda: [F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]
    # written once: every level above is a sum of these
    hosts = checkpointed(read.where("main is not null").groupBy("host").agg(*per))
    hosts = hosts.withColumn("domain", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    domains = hosts.groupBy("domain", "suffix").agg(*add())
    suffixes = domains.groupBy("suffix").agg(*add())
    everything = suffixes.agg(*add())

    counts = F.array(*[F.col(f"c{i}") for i in range(k)])
    size = sum((F.col(f"c{i}") for i in range(k)), F.lit(0.0))
    overall = everything.select(F.transform(counts, lambda c: (c + 1.0) / (size + float(k))).alias("p"))  # one row

    def smoothed(keys: list[str], with_above: DataFrame) -> DataFrame:
        mix = F.zip_with(counts, "q", lambda c, q: (c + HOST_WEIGHT * q) / (size + HOST_WEIGHT))
        return with_above.select(*keys, mix.alias("p"), size.alias("n"))

    above = lambda df, on: df.select(on, F.col("p").alias("q"))
    by_suffix = smoothed(["suffix"], suffixes.withColumn("q", overall.scalar()))
    by_domain = smoothed(["domain"], domains.join(above(by_suffix, "suffix"), "suffix"))
    by_host = smoothed(["host"], hosts.join(above(by_domain, "domain"), "domain"))
    return by_host.select("host", F.col("n").alias("n_host"), everything.select(size).scalar().alias("n_all"), F.col("p").alias("prior"))


HOT_SHARE = 10_000
DOCUMENTS_PER_SALT = 200_000


def with_priors(read: DataFrame, priors: DataFrame, k: int, n_all: int, hot_share: int = HOT_SHARE, per_salt: int = DOCUMENTS_PER_SALT) -> DataFrame:
    """``read`` with the ``prior`` of its host; without one (no document of the host has letters) all languages are alike."""
    few = F.broadcast(priors.where(F.col("n_host") * hot_share >= n_all).select("host", "prior"))  # at most hot_share rows
    salts = max(1, -(-n_all // (hot_share * per_salt)))
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    copies = priors.where(F.col("n_host") * hot_share < n_all).select("host", "prior", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rest = read.join(few.select("host"), "host", "left_anti").withColumn("salt", salt).join(copies, ["host", "salt"], "left").drop("salt")
    flat = F.array(*[F.lit(1.0 / k)] * k)
    return read.join(few, "host").unionByName(rest.withColumn("prior", F.coalesce("prior", flat)))


def passages(documents: DataFrame, model: TextModel, names: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, label, passages): the language the label names, and passages with language and confidence."""
    spark = documents.sparkSession
    k = len(model.languages)
    shared = spark.sparkContext.broadcast(model)  # bounded by the samples
    declared = declared_languages(F.col("raw_bytes"), F.col("headers"), names)
    texts = documents.select(
        F.col(f"`{key}`").alias("key"),
        named_language(F.col("lang"), names).alias("label"),
        F.lower(F.coalesce(F.col("source"), F.lit(""))).alias("host"),
        *(c.alias(n) for n, c in declared.items()),
        F.col("text"),
    )
    kind = dict(texts.dtypes)["key"]
    read = checkpointed(texts.mapInArrow(_read_texts(shared), f"key {kind}, label string, host string, markup string, header string, main tinyint, passages array<{_PASSAGE}>"))
    lang = F.array(*[F.lit(x) for x in model.languages])[F.col("main")]
    told = read.where("main is not null").agg(
        F.count("*").alias("n_all"),
        *(F.sum((F.col(c) == lang).cast("int")).alias(f"{c}_right") for c in declared),
        *(F.count(F.when(F.col(c).isin(*model.languages), 1)).alias(f"{c}_all") for c in declared),
    )
    counts = told.first()  # five numbers
    rates = {c: ((counts[f"{c}_right"] or 0) + 1) / (counts[f"{c}_all"] + 2) for c in declared}
    priors = checkpointed(host_priors(read, k))  # one row per host, used more than once
    placed = with_priors(read, priors, k, counts["n_all"])
    schema = f"key {kind}, label string, passages array<struct<`from`:int,`to`:int,letters:int,lang:string,confidence:double>>"
    return placed.select("key", "label", *declared, "prior", "passages").mapInArrow(_fuse(model.languages, rates), schema).withColumnsRenamed({"key": key})


def languages_of(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, total, lang, letters, confidence): one row per language that a document has passages of."""
    kinds = F.array_distinct(F.transform("passages", lambda p: p["lang"]))
    total = F.aggregate("passages", F.lit(0), lambda a, p: a + p["letters"])

    def of(lang: Column) -> Column:
        own = F.filter("passages", lambda p: p["lang"] == lang)
        letters = F.aggregate(own, F.lit(0), lambda a, p: a + p["letters"])
        sure = F.aggregate(own, F.lit(0.0), lambda a, p: a + p["letters"] * p["confidence"])
        return F.struct(lang.alias("lang"), letters.alias("letters"), (sure / letters).alias("confidence"))

    return found.select(key, "label", total.alias("total"), F.explode(F.transform(kinds, of)).alias("l")).select(key, "label", "total", "l.*")


def wrong_labels(found: DataFrame, key: str = "doc_id", min_letters: int = 60, share: int = 5) -> DataFrame:
    """(key, lang) of documents in which several languages count, or whose label does not name the only one.

    A language counts if at least 1/``share`` of the letters stand in its passages.
    """
    kinds = F.array_distinct(F.transform("passages", lambda p: p["lang"]))
    total = F.aggregate("passages", F.lit(0), lambda a, p: a + p["letters"])
    counting = F.filter(kinds, lambda lang: F.aggregate(F.filter("passages", lambda p: p["lang"] == lang), F.lit(0), lambda a, p: a + p["letters"]) * share >= total)
    return (
        found.where(total >= min_letters)
        .select(key, "label", counting.alias("langs"))
        .where((F.size("langs") > 1) | ~F.coalesce(F.array_contains("langs", F.col("label")), F.lit(False)))
        .select(key, F.explode("langs").alias("lang"))
    )
