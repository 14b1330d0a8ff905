"""One prompt per alert, its message list, and the checks on what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.functions import fixed_values as fv

SCORE_SOURCES = ("price", "pop", "telecom", "card")
SCORE_COLUMNS = tuple(f"{s}_score" for s in SCORE_SOURCES)
ALERT_COLUMNS = (
    "region_key",
    "sgg",
    "emd",
    "district_code",
    "district_geom",
    "alert_date",
    "alert_type",
    "combined_score",
    *SCORE_COLUMNS,
    "dominant_age_group",
    "income_profile",
    "trending_rentals",
)


def _templates() -> Column:
    """Label to template, as one literal map: the texts are data, looked up by label."""
    entries = []
    for members, label in fv.ALERT_LABELS:
        t = fv.PROMPT_TEMPLATES[label]
        fallback = fv.INCOME_FALLBACK_PRICE if "price" in members else fv.INCOME_FALLBACK_OTHER
        fields = {
            "strength": t["strength"],
            "market": t.get("market"),
            "demand": t["demand"],
            "rental": t.get("rental", False),
            "service": t["service"],
            "condition": t.get("condition"),
            "ban": t.get("ban", fv.BAN_SHORT),
            "income": fallback,
        }
        columns = [
            (F.lit(v) if isinstance(v, bool) else F.lit(v).cast("string")).alias(k) for k, v in fields.items()
        ]
        entries += [F.lit(label), F.struct(*columns)]
    return F.create_map(*entries)


def _filled(template: Column) -> Column:
    """Put the rounded percentiles and the score rank into a template line."""
    for s in SCORE_SOURCES:
        number = F.coalesce(X.number_text(F.col(f"{s}_percentile") * 100), F.lit(""))
        template = F.replace(template, F.lit("{" + s + "}"), number)
    rank = F.coalesce(X.number_text((F.lit(1) - F.col("combined_score")) * 100), F.lit(""))
    return F.replace(template, F.lit("{top}"), rank)


def _line(tag: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"\n[{tag}] "), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _optional(line: Column) -> Column:
    return F.coalesce(line, F.lit(""))


def rounded_scores() -> list[Column]:
    """Combined score and the place of each signal, with three digits."""
    combined = X.half_up(F.col("combined_score"), 3).alias("combined_score")
    return [combined, *[X.half_up(F.col(f"{s}_percentile"), 3).alias(f"{s}_score") for s in SCORE_SOURCES]]


def alert_points(candidates: DataFrame) -> DataFrame:
    """Candidate alerts with their rounded scores only, for figures that need neither profile nor text."""
    return candidates.select("region_key", "sgg", "alert_date", "alert_type", *rounded_scores())


def _directions() -> Column:
    """Which way each flagged signal went, as one text; null when none is flagged."""
    words = []
    for s in SCORE_SOURCES:
        way = F.when(F.col(f"{s}_percentile") > fv.NEUTRAL, fv.DIRECTION_UP).otherwise(fv.DIRECTION_DOWN)
        name = F.concat(F.lit(fv.SCORE_NAMES[f"{s}_score"] + " "), way)
        words.append(F.when(F.col(f"{s}_is_anomaly") & F.col(f"{s}_percentile").isNotNull(), name))
    return F.nullif(F.concat_ws(" / ", *words), F.lit(""))


def drafts(
    candidates: DataFrame, top_rental: DataFrame, call_text: DataFrame, with_direction: bool = False
) -> DataFrame:
    """Candidate alerts with rounded scores, the product text, the prompt and the message list, in one pass.

    The texts speak of rises whichever way a signal went; with_direction adds a line that says it.
    The two context texts are scalar subqueries: an empty context gives null and the fallback text, never fewer rows.
    """
    known = F.col("alert_type").isin(*[label for _, label in fv.ALERT_LABELS])
    label = F.when(known, F.col("alert_type")).otherwise(fv.DEFAULT_TEMPLATE_LABEL)
    framed = (
        candidates.withColumn("t", F.element_at(_templates(), label))
        .withColumn("rental_products", top_rental.scalar())
        .withColumn("call_context", call_text.scalar())
    )
    age = F.coalesce("dominant_age_group", F.lit(fv.AGE_FALLBACK))
    income = F.coalesce("income_profile", "t.income")
    products = F.coalesce("rental_products", F.lit(fv.RENTAL_FALLBACK))
    prompt = F.concat(
        F.lit(fv.PROMPT_OPENING + "\n"),
        _line("지역", F.col("sgg"), " (", X.month_text(F.col("alert_date")), ")"),
        _line("고객", age, " / ", income),
        _line("경보강도", _filled(F.col("t.strength"))),
        _optional(_line("시장신호", _filled(F.col("t.market")))),
        _line("수요강도", F.coalesce("call_context", "t.demand")),
        F.when(F.col("t.rental"), _line("인기상품", products, fv.RENTAL_MUST_MENTION)).otherwise(""),
        _line("서비스", F.col("t.service")),
        _optional(_line("조건", F.col("t.condition"))),
        _optional(_line(fv.DIRECTION_TAG, _directions())) if with_direction else F.lit(""),
        _line("금지", F.col("t.ban")),
    )
    drafted = framed.select(
        *[c for c in ALERT_COLUMNS if c not in ("combined_score", "trending_rentals", *SCORE_COLUMNS)],
        *rounded_scores(),
        F.col("rental_products").alias("trending_rentals"),
        prompt.alias("prompt"),
    )
    messages = F.to_json(_messages(F.col("prompt")))
    return (
        drafted.withColumn("messages", messages)
        .withColumn("temperature", F.lit(fv.TEMPERATURE))
        .withColumn("prompt_hash", F.sha2("messages", 256))
    )


def alert_scores(drafted: DataFrame) -> DataFrame:
    """The alert columns of the drafts; without a text column Spark does not build the texts."""
    return drafted.select(*ALERT_COLUMNS)


def _messages(prompt: Column) -> Column:
    """Message list of a chat request."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(fv.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
    )


def copy_text(responses: DataFrame, path: str = fv.RESPONSE_PATH) -> DataFrame:
    """The text of a completion reply by path; null for a missing path or a broken reply."""
    reply = F.try_parse_json("response")
    return responses.withColumn("marketing_copy", F.try_variant_get(reply, path, "string"))


def copy_check(copies: DataFrame, max_length: int = fv.MAX_COPY_LENGTH) -> DataFrame:
    """Does a text follow the output rules? Lists the rules it breaks."""
    text = F.col("marketing_copy")
    broken = F.array_compact(
        F.array(
            F.when(text.isNull() | (F.length(text) == 0), F.lit("empty")),
            F.when(~F.contains(text, F.col("sgg")), F.lit("no_region")),
            F.when(F.length(text) > max_length, F.lit("too_long")),
            F.when(text.rlike("[\\r\\n]"), F.lit("many_lines")),
            F.when(F.contains(text, F.lit('"')), F.lit("quotes")),
        )
    )
    return copies.select(
        "region_key",
        "sgg",
        "alert_date",
        "marketing_copy",
        (F.size(broken) == 0).alias("is_valid"),
        F.array_join(broken, ",").alias("reasons"),
    )
