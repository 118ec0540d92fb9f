"""Quality rules judged per document and per host, with DataFrame functions only.

Each document is measured once. For each host and rule the share of failing documents is shrunk towards the corpus
by a beta prior whose mean and strength come from the hosts themselves (method of moments). A document that fails a
rule is dropped where that failure is a habit of its host; a lone failure on a host that hardly ever fails the rule
is forgiven, and a document that fails nothing stays wherever it comes from. The two base rules hold on any host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import joined, saved

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repetitive", "symbols", "dup_lines", "word_length")


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    symbols_per_word: float = 0.1
    dup_line_share: float = 0.3
    word_length: tuple[float, float] = (2.5, 12.0)
    host_rate: float = 0.02
    prior_strength: tuple[float, float] = (1.0, 1000.0)


def _shifted(xs: Column, by: int) -> Column:
    """xs without its first by elements."""
    return F.slice(xs, F.lit(by + 1), F.greatest(F.size(xs) - by, F.lit(0)))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with columns _n_words, _word_chars, _n_symbols, _n_lines, _n_dup_lines, _n_repeat_words.

    Windows of five words are compared by 64-bit hashes of their words. Only documents with an equal pair of windows
    are sorted to find which words these cover."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("_n_symbols", (F.length(text) - F.length(bare)).cast("long")).withColumns({"_words": F.filter(F.split(text, WORD_BREAK), lambda w: w != ""), "_lines": lines})
    d = d.withColumns(
        {
            "_n_words": F.size("_words").cast("long"),
            "_word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    pair = lambda a, b: F.xxhash64(a, b)
    d = d.withColumn("_h2", F.zip_with("_h", _shifted(F.col("_h"), 1), pair))
    d = d.withColumn("_h4", F.zip_with("_h2", _shifted(F.col("_h2"), 2), pair))
    whole = F.slice(F.zip_with("_h4", _shifted(F.col("_h"), 4), pair), F.lit(1), F.greatest(F.size("_h") - 4, F.lit(0)))
    d = d.withColumn("_g", whole).drop("_h", "_h2", "_h4")
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    d = d.withColumn("_s", F.when(again, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_g")
    pairs = F.filter(F.zip_with("_s", _shifted(F.col("_s"), 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    d = d.withColumn("_at", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("_s")
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"))
    return d.withColumn("_n_repeat_words", F.coalesce(F.aggregate("_at", start, step, lambda acc: acc["n"]), F.lit(0).cast("long"))).drop("_at")


def _failures(limits: Limits) -> dict[str, Column]:
    n, mean = F.col("_n_words"), F.col("_word_chars") / F.greatest(F.col("_n_words"), F.lit(1))
    return {
        "short": n < limits.min_words,
        "repetitive": 100 * F.col("_n_repeat_words") > limits.repeat_percent * n,
        "symbols": F.col("_n_symbols") > limits.symbols_per_word * n,
        "dup_lines": F.col("_n_dup_lines") > limits.dup_line_share * F.col("_n_lines"),
        "word_length": (mean < limits.word_length[0]) | (mean > limits.word_length[1]),
    }


def host_rates(judged: DataFrame, limits: Limits) -> DataFrame:
    """Rows (_host, _rate_<rule>...): each host's shrunk share of failing documents.

    Only the prior, two numbers a rule, comes to the driver."""
    hosts = saved(judged.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"_f_{r}").cast("long")).alias(r) for r in RULES]))
    prior = hosts.agg(F.sum("n").alias("n"), *[F.sum(r).alias(f"k_{r}") for r in RULES], *[F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in RULES]).first()
    rates = []
    for r in RULES:
        mean = (prior[f"k_{r}"] or 0) / max(prior["n"] or 0, 1)
        low, high = limits.prior_strength
        strength = min(max(mean * (1 - mean) / prior[f"v_{r}"] - 1, low), high) if prior[f"v_{r}"] else high
        rates.append(((F.col(r) + F.lit(strength * mean)) / (F.col("n") + F.lit(strength))).alias(f"_rate_{r}"))
    return hosts.select("_host", *rates)


def judged(docs: DataFrame, text_col: str = "text", host: str | Column = "source", keep: tuple[str, ...] = (), limits: Limits | None = None) -> DataFrame:
    """Columns keep, the measures, _base_failed and _kept for each row of docs.

    A null text counts as empty and so fails for its length; rows with a null host form one host; rows that repeat
    are judged, and returned, as often as they come; texts are whole, however long; other columns are not looked at. An
    empty table gives an empty result."""
    limits = limits or Limits()
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.select(*keep, F.coalesce(host, F.lit("")).alias("_host"), F.col(text_col).alias("_text"))
    d = measured(rows, "_text").drop("_text")
    d = saved(d.withColumns({f"_f_{r}": c for r, c in _failures(limits).items()}))
    d = joined(d, host_rates(d, limits), "_host", "_word_chars")  # a host with very many documents is dealt over tasks
    habit = F.lit(False)
    for r in RULES:
        habit = habit | (F.col(f"_f_{r}") & (F.col(f"_rate_{r}") > limits.host_rate))
    d = d.withColumn("_base_failed", F.col("_f_short") | F.col("_f_repetitive"))
    return d.withColumn("_kept", ~F.col("_base_failed") & ~habit)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Cases as in judged(); texts are whole, however long.

    A verdict depends on a row's text and host alone. Rows are found again by two hashes of id, text and host, so that
    rows with equal ids, or equal texts on other hosts, have each their own verdict, and copies are spread by their ids."""
    host = F.col(host) if isinstance(host, str) else host
    parts = [F.col(id_col).cast("string"), F.col(text_col), host]
    mark = [x for p in parts for x in (p.isNull(), p)]
    key = [F.xxhash64(*mark).alias("_k1"), F.xxhash64(F.lit("second"), *mark).alias("_k2")]
    good = judged(docs.select(*key, F.col(text_col).alias("_t"), host.alias("_src")), "_t", "_src", ("_k1", "_k2")).where("_kept").select("_k1", "_k2").distinct()
    return docs.join(good, (key[0] == good["_k1"]) & (key[1] == good["_k2"]), "left_semi")
