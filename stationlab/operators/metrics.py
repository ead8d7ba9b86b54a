"""Derived columns of a reading and the full metrics table."""

from pyspark.sql import DataFrame

from stationlab.functions import comfort_index, felt_temperature, pressure_to_pa, rain_risk
from stationlab.operators.anomalies import flag_anomalies, thresholds
from stationlab.operators.blocks import BLOCK_ROWS
from stationlab.operators.filters import drop_incomplete
from stationlab.operators.windows import rolling_metrics
from stationlab.schemas import METRICS


def enrich(df: DataFrame, pressure_unit: str = "Pa") -> DataFrame:
    """Comfort, rain risk and felt temperature in one projection; works on streams."""
    return df.withColumns(
        {
            "indice_confort": comfort_index(),
            "risque_precipitation": rain_risk("humidite", pressure_to_pa("pression", pressure_unit)),
            "temperature_ressentie": felt_temperature(),
        }
    )


def compute_metrics(
    df: DataFrame,
    mode: str = "rows",
    pressure_unit: str = "Pa",
    exact: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Clean, roll, enrich and flag: every column of the batch result.

    Thresholds come from the cleaned rows themselves, not from behind the windows,
    so their pass reads three columns and needs no shuffle of rows.
    """
    clean = drop_incomplete(df)
    measures = clean.select("temperature", "vitesse_vent", "pression")
    rolled = enrich(rolling_metrics(clean, mode, block_rows=block_rows), pressure_unit)
    return flag_anomalies(rolled, thresholds(measures, exact=exact))


def metrics_table(computed: DataFrame) -> DataFrame:
    """The columns of the stored metrics table."""
    return computed.select(*METRICS.names)


