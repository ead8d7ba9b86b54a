"""Text, JSON and calendar functions over whole columns."""

from pyspark.sql import functions as F

from stationlab import adapters
from stationlab.catalogue.registry import AS_OF, query, r
from stationlab.functions import day_string, has_any_term, json_field, payload_preview, rain_to_show
from stationlab.functions.routing import DEFAULT_DAYS, DEFAULT_ROUTE, MAX_NUMBER, ROUTES
from stationlab.operators.filters import moment
from stationlab.plans.questions import label_questions

TS = '"timestamp"'


def _route_sql(text: str) -> str:
    quoted = [(p.replace("'", "''"), name) for p, name in ROUTES]
    cases = " ".join(f"WHEN regexp_matches(lower({text}), '{p}') THEN '{name}'" for p, name in quoted)
    return f"CASE {cases} ELSE '{DEFAULT_ROUTE}' END AS route"


def _days_sql(text: str) -> str:
    number = f"TRY_CAST(regexp_extract({text}, '[0-9]+') AS INT)"
    return f"CASE WHEN {number} <= {MAX_NUMBER} THEN {number} ELSE {DEFAULT_DAYS} END AS jours"


@query(
    "X18_X19_E4_route_conversations",
    f"SELECT conv_id, turn, {_route_sql('text')}, {_days_sql('text')} FROM conversations",
)
def route_conversations(spark, folder):
    labelled = label_questions(adapters.table(spark, folder, "conversations"))
    return labelled.select("conv_id", "turn", "route", "jours")


@query(
    "X18_X19_route_documents",
    f"SELECT doc_id, {_route_sql('text')}, {_days_sql('text')} FROM documents",
)
def route_documents(spark, folder):
    return label_questions(adapters.table(spark, folder, "documents")).select(
        "doc_id", "route", "jours"
    )


@query("X16_payload_preview", "SELECT doc_id, n_chars, substring(text, 1, 100) AS apercu FROM documents")
def preview(spark, folder):
    return adapters.table(spark, folder, "documents").select(
        "doc_id", "n_chars", payload_preview("text").alias("apercu")
    )


@query(
    "X21_metadata_field",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k,
      coalesce(CAST(json_extract(props, '$.k') AS INT) = 42, false) AS contient FROM events""",
)
def metadata_field(spark, folder):
    k = json_field("props", "$.k", "int")
    return adapters.table(spark, folder, "events").select(
        "event_id", k.alias("k"), F.coalesce(k == 42, F.lit(False)).alias("contient")
    )


WANTED = ["worthless", "pour", "Nicht"]


@query(
    "X23_text_match",
    r"""SELECT doc_id, coalesce(list_has_any(
      string_split_regex(lower(text), '[^\p{L}\p{N}]+'), ['worthless', 'pour', 'nicht']), false)
      AS trouve FROM documents""",
)
def text_match(spark, folder):
    return adapters.table(spark, folder, "documents").select(
        "doc_id", has_any_term("text", WANTED).alias("trouve")
    )


@query(
    "X8_X9_X10_X24_calendar",
    f"""SELECT station, {TS}, strftime({TS}, '%Y-%m-%d') AS jour_texte, CAST({TS} AS DATE) AS jour,
      CAST(date_trunc('month', {TS}) AS TIMESTAMP) AS mois,
      CAST(TIMESTAMP '{AS_OF}' AS DATE) - 1 = CAST({TS} AS DATE) AS veille FROM readings""",
    ("readings",),
)
def calendar(spark, folder):
    df = adapters.readings(spark, folder)
    return df.select(
        "station",
        "timestamp",
        day_string("timestamp").alias("jour_texte"),
        F.to_date("timestamp").alias("jour"),
        F.date_trunc("month", "timestamp").alias("mois"),
        (F.to_date("timestamp") == F.date_sub(F.to_date(moment(df, AS_OF)), 1)).alias("veille"),
    )


@query(
    "X25_rain_to_show",
    f"""SELECT station, {TS}, {r('precipitation')}, coalesce(precipitation > 0, false) AS affiche
    FROM readings""",
    ("readings",),
)
def rain(spark, folder):
    return adapters.readings(spark, folder).select(
        "station", "timestamp", "precipitation", rain_to_show().alias("affiche")
    )
