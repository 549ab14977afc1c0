"""Records whose text was read in a wrong character encoding, and their restored text, as Spark jobs over the cipher model."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import iso3
from ..operators.skew import hot_keys, repeated, sliced, sliced_join
from ..session import stored
from . import ciphers

#: A character is usual in a language if at least this share of its texts has it; ideographs are many and rarer.
USUAL_SHARE, USUAL_IDEOGRAPH_SHARE = 0.03, 0.002
#: Least shares of a word among a language's words and of a pair among its pairs. They bound a language's model, which goes to every task:
#: it has at most their inverses, at any size of the data. What languages there are is a closed list.
WORD_SHARE, PAIR_SHARE = 2e-6, 1e-6
#: Least texts of a language with a model of its own. Rarer languages take the model of all texts together, which has the key POOLED.
LEAST_TEXTS, POOLED = 100, ""
#: Rounds of the mixture, share of a swap before the first, and least certainty that a record is garbled.
ROUNDS, FIRST_SHARE, LEAST_CERTAINTY = 4, 1e-3, 0.05
#: An unlisted cipher is learned from so many places of its symbols at least, and is believed if so many tokens become words under it, and such a
#: share of the strange tokens of its source and language.
LEAST_PLACES, LEAST_WORDS, LEAST_WORD_SHARE = 300, 20, 0.1
#: Records of one source and language from which on they are spread over several tasks.
HOT_ROWS = 50_000
_FLUSH = 300_000


class Models(dict):
    """Language models by language code; sent to the executors once."""

    def shared(self, spark: SparkSession) -> tuple[str, Broadcast]:
        if not hasattr(self, "_sent"):
            self._sent = uuid.uuid4().hex, spark.sparkContext.broadcast({lang: (m.pairs, m.words, m.usual, m.pooled) for lang, m in self.items()})
        return self._sent


def _here(sent: tuple[str, Broadcast]) -> dict[str, ciphers.Language]:
    return ciphers.made(sent[0], sent[1])


def _totals(counts: Counter) -> Iterator[pa.RecordBatch]:
    rows = [(lang, kind, s, n) for (lang, kind, s), n in counts.items()]
    for at in range(0, len(rows), 50_000):
        lang, kind, s, n = zip(*rows[at : at + 50_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(kind, pa.string()), pa.array(s, pa.string()), pa.array(n, pa.int64())], ["lang", "kind", "s", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: texts, texts with each character, and tokens."""
    counts: Counter = Counter()
    by: dict[str, list[Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (tokens, chars) in by.items():
            for t, n in tokens.items():
                counts[lang, "token", ciphers.flat(t)] += n
            for c, n in chars.items():
                counts[lang, "char", c] += n
        by.clear()
        yield from _totals(counts)
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in by:
                by[lang] = [Counter(), Counter()]
            tokens, chars = by[lang]
            tokens.update(text.split())
            chars.update(set(text))
            counts[lang, "texts", ""] += 1
        if sum(len(t) for t, _ in by.values()) > _FLUSH:
            yield from flush()
    yield from flush()


def _pairs_and_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for lang, token, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            padded = f" {token} "
            for p in map("".join, zip(padded, padded[1:])):
                counts[lang, "pair", p] += n
            if entry := ciphers.word(token):
                counts[lang, "word", entry] += n
        if len(counts) > _FLUSH:
            yield from _totals(counts)
            counts.clear()
    yield from _totals(counts)


_KINDS = "lang string, kind string, s string, n bigint"


def language_models(records: DataFrame) -> Models:
    """Models of all languages of the records (lang, text), from counts over all of them.

    What comes to the driver is bounded by the least shares above for each language, whatever the size of the tables. Text that was misread in a common way counts
    in them too and is taken out of the models again. Languages with few texts have one model, POOLED, which is that of all texts.
    """
    counts = stored(records.select("lang", "text").mapInArrow(_counted, _KINDS).groupBy("lang", "kind", "s").agg(F.sum("n").alias("n")))
    texts = {r["lang"]: r["n"] for r in counts.where("kind = 'texts'").collect()}
    whole = sum(texts.values())
    if not whole:
        return Models()
    kept = [lang for lang, n in texts.items() if n >= LEAST_TEXTS]
    if len(kept) < len(texts):
        every = counts.groupBy("kind", "s").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "kind", "s", "n")
        counts = counts.where(F.col("lang").isin(kept)).unionByName(every)
        kept.append(POOLED)
        texts[POOLED] = whole
    size = F.create_map(*[x for lang in kept for x in (F.lit(lang), F.lit(texts[lang]))])
    own = counts.where(F.col("lang").isin(kept))
    least = F.when(F.col("s").rlike("[\\u4e00-\\u9fff]"), USUAL_IDEOGRAPH_SHARE).otherwise(USUAL_SHARE)
    usual = own.where("kind = 'char'").where(F.col("n") >= least * size[F.col("lang")]).select("lang", "s").collect()
    parts = stored(own.where("kind = 'token'").select("lang", "s", "n").mapInArrow(_pairs_and_words, _KINDS).groupBy("lang", "kind", "s").agg(F.sum("n").alias("n")))
    sums = parts.groupBy("lang", "kind").agg(F.sum("n").alias("of"))
    floor = F.when(F.col("kind") == "word", F.greatest(F.lit(3.0), WORD_SHARE * F.col("of"))).otherwise(PAIR_SHARE * F.col("of"))
    rows = parts.join(sums, ["lang", "kind"]).where(F.col("n") >= floor).select("lang", "kind", "s", "n").collect()
    models: dict[str, tuple[dict[str, int], dict[str, int], set[str]]] = {lang: ({}, {}, set()) for lang in kept}
    for r in usual:
        models[r["lang"]][2].add(r["s"])
    for r in rows:
        models[r["lang"]][0 if r["kind"] == "pair" else 1][r["s"]] = r["n"]
    return Models({lang: ciphers.Language(*ciphers.without_misread(*(m if lang == POOLED else ciphers.of_own_scripts(*m))), lang == POOLED) for lang, m in models.items()})


def _model(models: dict[str, ciphers.Language], lang: str | None) -> ciphers.Language | None:
    return models.get(lang) or models.get(POOLED)


_GAINS = pa.list_(pa.struct([("swap", pa.string()), ("gain", pa.float64())]))


_NONE = ciphers.Language({}, {}, set())


def _scored(sent: tuple[str, Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(sent)
        for batch in batches:
            at, found, rest = [], [], []
            for i, (lang, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if not text.isascii():
                    language = _model(own, lang) or _NONE
                    x, left = ciphers.gains(text, language)
                    if x or left:
                        at.append(i)
                        found.append([{"swap": k, "gain": v} for k, v in x.items()])
                        rest.append(left)
            if at:
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(found, _GAINS), pa.array(rest, pa.list_(pa.string())), kept.column(3), kept.column(4)], ["field_name", "rec_key", "source", "gains", "strange", "lang", "text"])

    return run


def suspects(records: DataFrame, models: Models) -> DataFrame:
    """Records with a token that some listed swap makes much likelier, or a strange one: (field_name, rec_key, source, gains, strange, lang, text)."""
    return records.select("field_name", "rec_key", "source", "lang", "text").mapInArrow(_scored(models.shared(records.sparkSession)), "field_name string, rec_key string, source string, gains array<struct<swap:string,gain:double>>, strange array<string>, lang string, text string")


def _token_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for source, lang, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for t in tokens:
                padded = f" {ciphers.digits(t)} "
                counts.update((source, lang, ciphers.UNLISTED, a, b) for a, b in zip(padded, padded[1:]))
    yield from _pair_rows(counts)


_PAIR_ROWS = "source string, lang string, swap string, a string, b string, n bigint"


def _pair_rows(counts: Counter) -> Iterator[pa.RecordBatch]:
    rows = [(*k, n) for k, n in counts.items()]
    if rows:
        kinds = [pa.string()] * 5 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["source", "lang", "swap", "a", "b", "n"])


def _solved(pairs: DataFrame, models: Models) -> DataFrame:
    """The mapping of each (source, lang, swap) out of sums of symbol pairs: (source, lang, swap, symbol, letter, certainty).

    A group is bounded by the square of the cipher's symbols, not by the data.
    """
    sent = models.shared(pairs.sparkSession)
    # few rows but much work on each group: a fixed number of partitions, so that they aren't put together by size
    pairs = pairs.groupBy("source", "lang", "swap", "a", "b").agg(F.sum("n").alias("n")).repartition(_tasks(pairs), "source", "lang", "swap")

    def solve(key: tuple[str, ...], group: pd.DataFrame) -> pd.DataFrame:
        counts = {(a, b): n for a, b, n in zip(group["a"], group["b"], group["n"], strict=True)}
        language = _model(_here(sent), key[1]) or _NONE
        if key[2] == ciphers.UNLISTED and sum(n for (_, b), n in counts.items() if ord(b) > 127 and b not in language.usual) < LEAST_PLACES:
            table = {}
        else:
            table = ciphers.learned(counts, key[2], language)
        upper = ciphers.capitals({x: c for x, (c, _) in table.items()}, counts) if key[2] == ciphers.UNLISTED else {}
        return pd.DataFrame([(*key, x, upper.get(x, c), sure) for x, (c, sure) in sorted(table.items())], columns=["source", "lang", "swap", "symbol", "letter", "certainty"])

    return pairs.groupBy("source", "lang", "swap").applyInPandas(solve, "source string, lang string, swap string, symbol string, letter string, certainty double")


def _entries(tables: DataFrame, least: float) -> DataFrame:
    return tables.where(F.col("certainty") >= least).groupBy("source", "lang", "swap").agg(F.sort_array(F.collect_list(F.struct("symbol", "letter"))).alias("entries"))


def _words_found(sent: tuple[str, Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(sent)
        for batch in batches:
            words, gains = [], []
            for lang, tokens, entries in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                language = _model(own, lang) or _NONE
                table = str.maketrans({e["symbol"]: e["letter"] for e in entries})
                forms = [(t, f) for t in tokens if (f := ciphers.deciphered(t, table, language))]
                words.append(len(forms))
                gains.append(sum(max(language.score(f) - language.score(t), 0.0) + math.log(language.words[ciphers.word(f)]) for t, f in forms))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(t) for t in batch.column(3).to_pylist()], pa.int64()), pa.array(words, pa.int64()), pa.array(gains, pa.float64())], ["row", "source", "lang", "tokens", "words", "gain"])

    return run


def unlisted(found: DataFrame, models: Models) -> DataFrame:
    """(row, source, gain) of records with words under a mapping that is on no list; `found` has (row, source, lang, strange).

    The strange tokens of each source and language are taken for one unknown substitution cipher. Its mapping is learned from the sums of their
    symbol pairs and applied with translate(); it is believed if it makes enough words of them.
    """
    rows = found.where(F.size("strange") > 0).select("row", "source", "lang", "strange")
    pairs = rows.select("source", "lang", "strange").mapInArrow(_token_pairs, _PAIR_ROWS)
    tables = _entries(_solved(pairs, models), 0.5).select("source", "lang", "entries")
    own = sliced_join(rows, tables, ["source", "lang"], hot_keys(rows, ["source", "lang"], HOT_ROWS), ["row"])
    own = stored(own.select("row", "source", "lang", "strange", "entries").mapInArrow(_words_found(models.shared(found.sparkSession)), "row bigint, source string, lang string, tokens bigint, words bigint, gain double"))
    sums = own.groupBy("source", "lang").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w"))
    believed = sums.where((F.col("w") >= LEAST_WORDS) & (F.col("w") >= LEAST_WORD_SHARE * F.col("t"))).select("source", "lang")
    hits = own.where("words > 0 and 2 * words >= least(tokens, 4)")
    return sliced_join(hits, believed, ["source", "lang"], hot_keys(hits, ["source", "lang"], HOT_ROWS), ["row"]).select("row", "source", "gain")


def garbled(records: DataFrame, models: Models | None = None) -> DataFrame:
    """Garbled records: (field_name, rec_key, source, lang, text, swap, certainty); a record of several texts comes once per text.

    `records` has (field_name, rec_key, source, lang, text); null texts and keys are left out. Each wrong decoding is a substitution cipher.
    What a text gains under each swap of code pages comes from the language's bigrams and words; tokens that none of them explains are taken
    for one more cipher per source, whose mapping is learned from their symbol pairs (swap `unlisted`). The shares of the swaps in each source are
    learned by expectation-maximisation over the sources' records (only sums per source and swap are gathered), and a record is garbled if
    it is so with LEAST_CERTAINTY under them. swap is its most probable one, `lost` if only characters of a failed decoding show it.
    """
    records = records.where("text is not null and rec_key is not null")
    models = language_models(records) if models is None else models
    found = stored(suspects(records, models).withColumn("row", F.xxhash64("field_name", "rec_key", "text")))
    sizes = records.groupBy("source").agg(F.count(F.lit(1)).alias("records"))
    rows = found.select("row", "source", F.explode("gains").alias("g")).select("row", "source", "g.swap", "g.gain")
    rows = rows.unionByName(unlisted(found, models).distinct().select("row", "source", F.lit(ciphers.UNLISTED).alias("swap"), "gain"))
    rows = stored(rows.withColumn("odds", F.exp(F.least(F.col("gain"), F.lit(50.0)))))
    share = stored(rows.select("source", "swap").distinct().withColumn("share", F.lit(FIRST_SHARE)))

    def weighed(share: DataFrame) -> DataFrame:
        return rows.join(share, ["source", "swap"]).withColumn("w", F.col("odds") * F.col("share"))

    for _ in range(ROUNDS):
        each = weighed(share)
        sums = each.groupBy("row", "source").agg(F.sum("w").alias("all"))
        part = each.join(sums, ["row", "source"]).groupBy("source", "swap").agg(F.sum(F.col("w") / (1 + F.col("all"))).alias("n"))
        share = stored(part.join(sizes, "source").select("source", "swap", ((F.col("n") + 0.5) / (F.col("records") + 1)).alias("share")))
    best = weighed(share).groupBy("row", "source").agg(F.max_by("swap", F.struct(F.col("swap") != "lost", F.col("gain") + F.log("share"), ~F.col("swap").startswith("mac"), "swap")).alias("swap"), F.sum("w").alias("all"))
    best = best.withColumn("certainty", F.col("all") / (1 + F.col("all"))).where(F.col("certainty") >= LEAST_CERTAINTY)
    return found.join(best.select("row", "source", "swap", "certainty"), ["row", "source"]).select("field_name", "rec_key", "source", "lang", "text", "swap", "certainty")


def _tasks(df: DataFrame) -> int:
    """Tasks for work that is heavy for its bytes."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _symbol_pairs(sent: tuple[str, Broadcast]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(sent)
        counts: Counter = Counter()
        for batch in batches:
            for source, lang, text, swap in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (language := _model(own, lang)) and swap != "lost":
                    for token in ciphers.TOKENS.findall(text):
                        if not token.isascii():
                            known = language.swaps(token)
                            if swap in known or swap == ciphers.UNLISTED and token in language.strange:
                                token = ciphers.digits(token.strip(ciphers.PUNCTUATION)) if swap == ciphers.UNLISTED else token
                                symbols = [" ", *ciphers.units(token, swap), " "]
                                counts.update((source, lang, swap, a, b) for a, b in zip(symbols, symbols[1:]))
        yield from _pair_rows(counts)

    return run


def cipher_tables(found: DataFrame, models: Models) -> DataFrame:
    """The mapping learned for each source, language and swap: (source, lang, swap, symbol, letter, certainty), letters in lower case but for
    symbols of capitals of unlisted swaps."""
    pairs = found.select("source", "lang", "text", "swap").mapInArrow(_symbol_pairs(models.shared(found.sparkSession)), _PAIR_ROWS)
    # ciphers of several levels and of double bytes are no tables of symbols: their texts follow the code pages
    return _solved(pairs.where("not swap like '%+%' and not swap like '%gbk%'"), models)


def restored(found: DataFrame, tables: DataFrame, models: Models, least: float = 0.6) -> DataFrame:
    """(field_name, rec_key, swap, restored) of garbled records; text that is lost, or that no swap explains, stays as it is.

    Each record meets the table of its source and swap; letters learned with less than `least` certainty follow the code pages.
    """
    sent = models.shared(found.sparkSession)
    key = ["source", "lang", "swap"]
    hot = hot_keys(found, key, HOT_ROWS)
    table = repeated(_entries(tables, least), key, hot)
    rows = sliced(found, key, hot, ["rec_key"]).join(table, [*key, "slice"], "left").select("field_name", "rec_key", "swap", "lang", "text", F.col("entries.symbol").alias("symbols"), F.col("entries.letter").alias("letters"))
    rows = rows.repartition(_tasks(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _here(sent)
        for batch in batches:
            swaps, langs, texts, symbols, letters = (batch.column(i).to_pylist() for i in range(2, 7))
            out = [t if s == "lost" or not (language := _model(own, lang)) else ciphers.restore(t, language, s, dict(zip(a or [], b or [], strict=True))) for s, lang, t, a, b in zip(swaps, langs, texts, symbols, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], ["field_name", "rec_key", "swap", "restored"])

    return rows.mapInArrow(run, "field_name string, rec_key string, swap string, restored string")


def records_of(load_documents: DataFrame, process_queries: DataFrame) -> DataFrame:
    """(field_name, rec_key, source, lang, text): documents by the letters of their ids, titles by language; a null language is that of most of the source."""
    docs = load_documents.select(F.lit("documents").alias("field_name"), F.col("doc_id").alias("rec_key"), F.substring("doc_id", 1, 2).alias("source"), iso3(F.col("lang")).alias("lang"), F.col("documents").alias("text"))
    usual = docs.where("lang is not null").groupBy("source", "lang").count().groupBy("source").agg(F.max_by("lang", F.struct("count", "lang")).alias("most"))
    # stored, so that Spark knows how small it is and moves it instead of the texts
    docs = docs.join(stored(usual), "source", "left").select("field_name", "rec_key", "source", F.coalesce("lang", "most", F.lit("und")).alias("lang"), "text")
    own = F.coalesce(iso3(F.col("lang")), F.lit("und"))
    titles = process_queries.select(F.lit("titles").alias("field_name"), F.concat("lang", F.lit("/"), "query_id").alias("rec_key"), F.concat(F.lit("titles/"), own).alias("source"), own.alias("lang"), F.col("titles").alias("text"))
    return docs.unionByName(titles).where("text is not null and rec_key is not null")
