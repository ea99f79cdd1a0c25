"""Dimensions: world blocs, country lists and names, routes and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Results must carry these names and group these codes.
BLOCS = {
    "China": ["CN", "HK"],
    "Asia Emergente": ["IN", "ID", "MY", "PH", "TH", "VN", "PK", "BD"],
    "Latinoamérica y Caribe": ["AR", "BO", "BR", "CL", "CO", "CR", "CU", "DO", "EC", "SV", "GT", "HN", "MX", "NI", "PA", "PY", "PE", "PR", "UY", "VE", "JM", "TT"],
    "África Subsahariana": ["ZA", "NG", "KE", "ET", "GH", "TZ", "UG", "SN", "CM", "CI", "ZW"],
    "MENA": ["DZ", "EG", "IR", "IQ", "JO", "KW", "LB", "LY", "MA", "OM", "PS", "QA", "SA", "SY", "TN", "AE", "YE"],
    "Norteamérica Anglosajona": ["US", "CA", "GB", "IE", "AU", "NZ"],
    "Europa Central/Occidental": ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GR", "IT", "LU", "NL", "NO", "PT", "SE", "IS", "IL"],
    "Europa del Este": ["PL", "CZ", "HU", "RO", "BG", "SK", "HR", "EE", "LV", "LT", "UA", "RU"],
    "Asia-Pacífico Desarrollado": ["JP", "KR", "SG", "TW"],
}
OTHER = "Other"
# The countries of the regional levels.
LATIN_AMERICA = ["MX", "BR", "AR", "CL", "CO", "PE", "VE", "EC", "CU", "UY", "CR", "BO", "DO", "GT", "PY", "SV", "HN", "NI", "PA", "PR"]
# Names as results show them.
COUNTRY_NAMES = {
    "AR": "Argentina", "AU": "Australia", "AT": "Austria", "BE": "Bélgica", "BR": "Brasil", "CA": "Canadá", "CL": "Chile", "CN": "China", "CO": "Colombia", "CR": "Costa Rica",
    "CU": "Cuba", "CZ": "República Checa", "DK": "Dinamarca", "EC": "Ecuador", "EG": "Egipto", "SV": "El Salvador", "ES": "España", "FI": "Finlandia", "FR": "Francia", "DE": "Alemania",
    "GR": "Grecia", "GT": "Guatemala", "HN": "Honduras", "IN": "India", "ID": "Indonesia", "IE": "Irlanda", "IL": "Israel", "IT": "Italia", "JP": "Japón", "MX": "México",
    "NL": "Países Bajos", "NZ": "Nueva Zelanda", "NO": "Noruega", "PK": "Pakistán", "PA": "Panamá", "PE": "Perú", "PL": "Polonia", "PT": "Portugal", "RU": "Rusia", "SA": "Arabia Saudita",
    "SG": "Singapur", "ZA": "Sudáfrica", "SE": "Suecia", "CH": "Suiza", "TR": "Turquía", "GB": "Reino Unido", "US": "Estados Unidos", "UY": "Uruguay", "VE": "Venezuela",
}
# Routes of open access and language codes that measures are named by.
ROUTES = ("gold", "diamond", "green", "hybrid", "bronze", "closed")
LANGUAGES = ("en", "fr", "de", "it", "la", "nd", "pt", "ru", "es")


def codes() -> list[str]:
    """All country codes that a bloc lists, in order."""
    return [c for listed in BLOCS.values() for c in listed]


def _lookup(pairs: dict[str, str], c: Column, default: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), c), default)


def bloc(country: Column) -> Column:
    return _lookup({c: name for name, listed in BLOCS.items() for c in listed}, country, F.lit(OTHER))


def first_bloc(countries: Column) -> Column:
    """The first bloc, in the table's order, that any of a work's countries is in."""
    chain = F
    for name, listed in BLOCS.items():
        chain = chain.when(F.arrays_overlap(countries, F.array(*map(F.lit, listed))), name)
    return chain.otherwise(OTHER)


def country_name(country: Column) -> Column:
    """The Spanish name, or the code where there is none."""
    return _lookup(COUNTRY_NAMES, country, country)


def table(spark: SparkSession) -> DataFrame:
    """country, region: a row per listed code, to join where a map is too long."""
    return spark.createDataFrame([(c, name) for name, listed in BLOCS.items() for c in listed], "country string, region string")


def iso3(df: DataFrame, column: str, codes_: DataFrame) -> DataFrame:
    """Adds iso3 from a table (iso2, iso3) of the caller; rows of unknown countries are dropped, as a map can't show them."""
    return df.join(codes_.select(F.col("iso2").alias(column), "iso3"), column)
