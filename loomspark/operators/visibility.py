"""Brand visibility: answers to mentions, scorecards and shares."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import percent, round2, short
from ..functions.text import competitors_in, find_mention

#: Run states, and what a sentiment label counts.
SUCCESS = "success"
SENTIMENT = {"positive": 1.0, "neutral": 0.0, "negative": -1.0}


def extract_mentions(answers: DataFrame, brand: str, competitors: list[str], text_col: str = "text") -> DataFrame:
    """The answers with mentioned, position, mention_count and competitors_mentioned."""
    found = find_mention(text_col, brand)
    out = answers.withColumn("_m", found).withColumn("competitors_mentioned", competitors_in(text_col, competitors))
    return out.withColumns({"mentioned": F.col("_m.present"), "position": F.col("_m.position"), "mention_count": F.col("_m.count")}).drop("_m")


def run_matrix(prompts: DataFrame, models: DataFrame) -> DataFrame:
    """Every prompt with every model, still to be asked. A short list of models, which is counted, goes to every task; a longer one stays distributed."""
    return prompts.crossJoin(short(models)).withColumn("status", F.lit("pending"))


def attach_run_id(answers: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id by (prompt_id, model); an answer without a run is an error."""
    joined = answers.join(runs.select("prompt_id", "model", "run_id"), ["prompt_id", "model"], "left")
    return joined.withColumn("run_id", F.when(F.col("run_id").isNull(), F.raise_error(F.lit("answer without a run"))).otherwise(F.col("run_id")))


def attach_category(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """category by prompt_id; unknown prompts keep null and count in no category."""
    return answers.join(prompts.select("prompt_id", "category"), "prompt_id", "left")


def successes(answers: DataFrame) -> DataFrame:
    return answers.where(F.col("status") == SUCCESS)


def mentioning(answers: DataFrame) -> DataFrame:
    return successes(answers).where("mentioned")


def _measures() -> list[Column]:
    ok, hit = F.col("status") == SUCCESS, (F.col("status") == SUCCESS) & F.col("mentioned")
    n_ok, n_hit = F.count_if(ok), F.count_if(hit)
    return [
        F.count("*").alias("total"),
        n_ok.alias("successful"),
        n_hit.alias("mentions"),
        percent(n_hit, n_ok).alias("visibility_pct"),
        round2(F.avg(F.when(hit, F.col("position")))).alias("position_avg"),
    ]


def brand_kpis(answers: DataFrame, keys: list[str]) -> DataFrame:
    return answers.groupBy(*keys).agg(*_measures())


def kpis_by(answers: DataFrame, column: str, domain: DataFrame, brands: list[str]) -> DataFrame:
    """KPIs for each value of a fixed domain, zeros where nothing was answered.

    The answers are read once: what they come to, for the domain's values alone, is listed by brand and laid out again.
    """
    values = short(domain.select(F.col(column).alias("_value")))
    rows = brand_kpis(answers, [*brands, column]).join(values.withColumn("_known", F.lit(True)), F.col(column) == F.col("_value"), "left")
    names = [c for c in rows.columns if c not in (*brands, column, "_value", "_known")]
    each = rows.groupBy(*brands).agg(F.collect_list(F.when(F.col("_known"), F.struct(column, *names))).alias("_rows"))
    own = F.try_element_at(F.filter("_rows", lambda r: r[column] == F.col("_value")), F.lit(1))
    laid = each.crossJoin(values).withColumn("_own", own)
    out = laid.select(*brands, F.col("_value").alias(column), *[F.col("_own")[n].alias(n) for n in names])
    return out.fillna(0, ["total", "successful", "mentions"]).fillna(0.0, ["visibility_pct"])


def scorecard(answers: DataFrame, brand: str = "brand") -> DataFrame:
    """Totals, by model and by category in one pass: level is brand, model or category."""
    sets = answers.groupingSets([[F.col(brand)], [F.col(brand), F.col("model")], [F.col(brand), F.col("category")]], F.col(brand), F.col("model"), F.col("category"))
    level = F.when(F.grouping("model") == 0, "model").when(F.grouping("category") == 0, "category").otherwise("brand")
    return sets.agg(level.alias("level"), *_measures())


def share_of_voice(answers: DataFrame, brand: str, competitors: list[str], keys: list[str]) -> DataFrame:
    """Mentions of the brand and of each competitor in successful answers, and their share; listed names always appear.

    One pass over the answers counts every listed name; the few counted rows are then turned into one row a name.
    """
    ok = F.col("status") == SUCCESS
    names = list(dict.fromkeys([brand, *competitors]))
    said = {n: F.array_contains("competitors_mentioned", n) for n in names}
    hits = [F.count_if(ok & said[n]) + (F.count_if(ok & F.col("mentioned")) if n == brand else F.lit(0)) for n in names]
    counts = answers.groupBy(*keys).agg(*[h.cast("long").alias(f"_{i}") for i, h in enumerate(hits)])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{i}").alias("mentions")) for i, n in enumerate(names)])
    total = sum((F.col(f"_{i}") for i in range(len(names))), F.lit(0))
    out = counts.select(*keys, total.alias("_all"), F.inline(rows))
    return out.select(*keys, "name", "mentions", percent(F.col("mentions"), F.col("_all")).alias("share_pct"))


def _judgement(raw: str | None) -> tuple[str, str | None]:
    """(sentiment, rationale) of a judge's answer: JSON, perhaps fenced; anything else is neutral."""
    try:
        said = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", raw.strip()).strip())
        label = str(said.get("sentiment") or "neutral").lower()
        return (label, said.get("rationale")) if label in SENTIMENT else ("neutral", None)
    except (AttributeError, TypeError, ValueError):
        return "neutral", "parse error" if raw else "no judge response"


def judge_sentiment(answers: DataFrame, snippet: str, judge: Callable[[list[str]], list[str | None]], size: int = 64) -> DataFrame:
    """The answers with ``sentiment`` and ``rationale`` of their snippets; both null where there is no snippet.

    ``judge`` runs in the tasks: it takes up to ``size`` snippets and gives as many texts, JSON with sentiment and
    rationale. A batch that fails, or gives too few, is asked again one by one; a snippet without a usable answer is neutral.
    """

    def asked(texts: list[str]) -> list[str | None]:
        try:
            said = judge(texts)
            if len(said) == len(texts):
                return list(said)
        except Exception:  # a judge may fail in any way; what matters is which snippets it fails on
            if len(texts) == 1:
                return [None]
        return [None] if len(texts) == 1 else [x for t in texts for x in asked([t])]

    @F.pandas_udf("sentiment string, rationale string")
    def verdicts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            some, out = part[part.notna()], pd.DataFrame({"sentiment": None, "rationale": None}, index=part.index, dtype=object)
            for i in range(0, len(some), size):
                texts = some.iloc[i : i + size]
                out.loc[texts.index] = [_judgement(x) for x in asked(texts.tolist())]
            yield out

    judged = answers.withColumn("_verdict", verdicts(snippet))
    return judged.withColumns({c: F.when(F.col(snippet).isNotNull(), F.col(f"_verdict.{c}")) for c in ("sentiment", "rationale")}).drop("_verdict")


def sentiment_stats(answers: DataFrame, label: str, keys: list[str]) -> DataFrame:
    value = F.element_at(F.create_map(*[F.lit(x) for p in SENTIMENT.items() for x in p]), F.col(label))
    return answers.where(F.col(label).isin(*SENTIMENT)).groupBy(*keys).agg(round2(F.avg(value)).alias("sentiment_avg"), *[F.count_if(F.col(label) == k).alias(k) for k in SENTIMENT])


def run_summary(answers: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    return answers.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states])


def score_to_tidy(scores: DataFrame, keys: list[str], maps: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """One row for each entry of the maps: dimension, label, value, the bar's width, which stops at 100, and its place from the largest value.

    ``labels`` gives some of the labels another text.
    """
    kind = "map<string,double>"

    def entries(name: str) -> Column:
        own = F.map_entries(F.coalesce(F.col(name).cast(kind), F.create_map().cast(kind)))
        return F.transform(own, lambda e: F.struct(F.lit(name).alias("dimension"), e["key"].alias("label"), e["value"].alias("value")))

    rows = scores.select(*keys, F.explode(F.flatten(F.array(*map(entries, maps)))).alias("e"))
    out = rows.select(*keys, "e.*").withColumns({"width": F.least(F.lit(100.0), F.col("value")), "place": F.row_number().over(Window.partitionBy(*keys, "dimension").orderBy(F.desc("value"), "label"))})
    if labels:
        names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
        out = out.withColumn("label", F.coalesce(names[F.col("label")], F.col("label")))
    return out
