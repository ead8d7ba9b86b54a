"""Declared schemas.  Nothing in this package infers a schema."""

from pyspark.sql import types as T

_D, _S, _TS = T.DoubleType(), T.StringType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


MEASURES = (
    "temperature",
    "humidite",
    "pression",
    "vitesse_vent",
    "direction_vent",
    "precipitation",
)
KEYS = ("timestamp", "station")
DAY = "jour"
"""The column by which stored tables are partitioned: the calendar day of the time, null without one."""

# One reading, in the column order of the batch CSV.
READINGS = _struct(timestamp=_TS, station=_S, **{m: _D for m in MEASURES})

# The same reading as a message value: the time travels as text.
WIRE = _struct(station=_S, timestamp=_S, **{m: _D for m in MEASURES})

READINGS_EXTENDED = T.StructType(
    READINGS.fields
    + _struct(
        rafale_max=_D,
        pluie_intensite_max=_D,
        station_type=_S,
        heure_paris=_S,
        station_name=_S,
    ).fields
)

# Landed open-data page.  Measures arrive as numbers or as text, so they are
# declared as text and cast on projection.
API_RECORD = _struct(
    heure_utc=_S,
    temperature_en_degre_c=_S,
    humidite=_S,
    pression=_S,
    force_moyenne_du_vecteur_vent=_S,
    direction_du_vecteur_vent_moyen=_S,
    pluie=_S,
    force_rafale_max=_S,
    pluie_intensite_max=_S,
    type_de_station=_S,
    heure_de_paris=_S,
)
API_ENVELOPE = _struct(total_count=T.LongType(), results=T.ArrayType(API_RECORD))

# source field -> reading column (fixed values)
API_MEASURES = {
    "temperature_en_degre_c": "temperature",
    "humidite": "humidite",
    "pression": "pression",
    "force_moyenne_du_vecteur_vent": "vitesse_vent",
    "direction_du_vecteur_vent_moyen": "direction_vent",
    "pluie": "precipitation",
    "force_rafale_max": "rafale_max",
    "pluie_intensite_max": "pluie_intensite_max",
}
API_LABELS = {
    "type_de_station": "station_type",
    "heure_de_paris": "heure_paris",
}

CITY_WEATHER = _struct(
    name=_S,
    main=_struct(temp=_D, humidity=_D, pressure=_D),
    wind=_struct(speed=_D, deg=_D),
    weather=T.ArrayType(_struct(description=_S)),
)

ALERT_BULLETIN = _struct(
    results=T.ArrayType(_struct(type_alerte=_S, niveau=_S, zone=_S, message=_S))
)
ALERT_MESSAGE = _struct(type_alerte=_S, niveau=_S, zone=_S, debut=_S, fin=_S, description=_S)

ALERTS = _struct(
    id=T.LongType(),
    type_alerte=_S,
    niveau=_S,
    zone=_S,
    debut=_TS,
    fin=_TS,
    description=_S,
    source=_S,
    severite=T.IntegerType(),
    active=T.BooleanType(),
)

URBAN_EVENTS = _struct(
    titre=_S,
    description=_S,
    type_evenement=_S,
    localisation=_S,
    debut=_TS,
    fin=_TS,
    impact_prevu=_S,
    source=_S,
    metadata=_S,
)

# Both published shapes of an event document, merged; absent fields are null.
EVENT_DOC = _struct(
    titre=_S,
    timestamp=_S,
    source=_S,
    type_evenement=_S,
    zone_geographique=_S,
    description=_S,
    contenu=_S,
    entites_extraites=T.ArrayType(_S),
    metadonnees=_struct(
        type_evenement=_S,
        niveau_severite=_S,
        zone_geographique=_S,
        impact_prevu=_S,
        duree_estimee=_S,
        niveau_confiance=_D,
        entites_extraites=T.ArrayType(_S),
    ),
    associations=T.ArrayType(_struct(type=_S, correlation=_D)),
)

METRICS = _struct(
    timestamp=_TS,
    station=_S,
    temp_moy_7j=_D,
    temp_moy_30j=_D,
    temp_volatilite_7j=_D,
    temp_volatilite_30j=_D,
    temp_tendance_24h=_D,
    indice_confort=_S,
    risque_precipitation=_S,
    temperature_ressentie=_D,
    score_anomalie_temp=_D,
    score_anomalie_vent=_D,
    score_anomalie_pression=_D,
)

CORRELATIONS = _struct(
    timestamp=_TS,
    type_correlation=_S,
    valeur_correlation=_D,
    variable_meteo=_S,
    variable_urbaine=_S,
    zone=_S,
    periode_analyse=_S,
    significativite=_D,
)

STATIONS = _struct(station=_S, station_name=_S)

# What a message source delivers, whatever the connector.
MESSAGES = _struct(key=_S, value=_S, topic=_S, timestamp=_TS)

# Topic names (fixed values).
TOPIC_READINGS = "topic_meteo_temps_reel"
TOPIC_ALERTS = "topic_alertes_meteo"
TOPIC_URBAN = "topic_evenements_urbains"
TOPIC_SETS = {
    "meteo": (TOPIC_READINGS,),
    "alertes": (TOPIC_ALERTS,),
    "all": (TOPIC_READINGS, TOPIC_ALERTS, TOPIC_URBAN),
}
