"""Request limits, redaction and log rows (GOV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits by key, redacted tokens, levels.
PER_MINUTE, PER_DAY = 60, 1_000
LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50}
MOST_TEXT = 2_048


def per_minute(requests: DataFrame) -> DataFrame:
    """GOV-01: key, minute, n."""
    return requests.groupBy("key", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))


def per_day(requests: DataFrame) -> DataFrame:
    """GOV-02."""
    return requests.groupBy("key", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def decide(requests: DataFrame, minute_limit: int = PER_MINUTE, day_limit: int = PER_DAY) -> DataFrame:
    """GOV-03: id and decision: accepted, rate_limited or quota_exceeded.

    Only accepted requests count. In order of time a request is accepted if
    fewer than the limit were accepted before it in its minute, and then in
    its day: the first ranks of the minute, and of those the first ranks of the day.
    """
    minute = F.row_number().over(Window.partitionBy("key", F.date_trunc("minute", "ts")).orderBy("ts", "id"))
    rows = requests.withColumn("_m", minute)
    ok = F.col("_m") <= minute_limit
    day = F.sum(ok.cast("int")).over(Window.partitionBy("key", F.to_date("ts")).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_d", day)
    decision = F.when(~ok, "rate_limited").when(F.col("_d") > day_limit, "quota_exceeded").otherwise("accepted")
    wait = F.when(~ok, F.greatest(F.lit(1), 60 - F.second("ts"))).when(F.col("_d") > day_limit, F.greatest(F.lit(1), 86_400 - (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")))).otherwise(0)
    return rows.select("id", "key", decision.alias("decision"), wait.cast("int").alias("retry_after"))


SENSITIVE_KEYS = ("password", "secret", "token", "authorization", "x-api-key", "api_key", "bearer")
TOKENS = (
    r"(?i)\bBearer\s+[A-Za-z0-9._-]{10,}",
    r"(?i)\bBasic\s+[A-Za-z0-9+/=]{8,}",
    r"(?i)\b(?:api|access|secret|auth|session)[-_ ]?key\s*[:=]\s*[A-Za-z0-9._-]{10,}",
)
REDACTED = "[REDACTED]"


def scrub(c: Column) -> Column:
    """GOV-05: token-like parts of a string."""
    for pattern in TOKENS:
        c = F.regexp_replace(c, pattern, REDACTED)
    return c


def scrub_map(c: Column) -> Column:
    """GOV-05: values of a map under sensitive keys, and token-like parts of the others."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), REDACTED).otherwise(scrub(v)))


def parse_api_key(c: Column) -> tuple[Column, Column, Column]:
    """GOV-04: prefix, id and secret of uak_prefix_id_secret, null where it isn't one."""
    pattern = r"^uak_([A-Za-z0-9]+)_([A-Za-z0-9-]+)_([A-Za-z0-9_-]+)$"
    return tuple(F.nullif(F.regexp_extract(c, pattern, k), F.lit("")) for k in (1, 2, 3))


def log_level(name: Column) -> tuple[Column, Column]:
    """GOV-06: level name and code; unknown and null are info."""
    known = F.when(F.lower(name).isin(*LEVELS), F.lower(name)).otherwise("info")
    code = F.lit(20)
    for k, v in LEVELS.items():
        code = F.when(known == k, v).otherwise(code)
    return known, code


def http_status(c: Column) -> Column:
    """GOV-06: whole numbers from 100 to 599."""
    value = c.try_cast("double")
    return F.when((value == F.floor(value)) & value.between(100, 599), value.cast("int"))


def cap_text(c: Column, most: int = MOST_TEXT) -> Column:
    """GOV-06."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("...(+"), (F.length(c) - most).cast("string"), F.lit(" chars)"))).otherwise(c)
