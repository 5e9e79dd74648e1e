"""The family read model: all tables derived from publications, built once and stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from patentkin.operators.applicants import applicant_candidates, applicant_family
from patentkin.operators.classification import cpc_index, with_cpc_titles
from patentkin.operators.families import rollup, score


@dataclass(frozen=True)
class FamilyModel:
    families: DataFrame
    codes: DataFrame
    titled: DataFrame
    applicants_by_family: DataFrame
    candidates: DataFrame


def family_model(patents: DataFrame, cpc_titles: DataFrame) -> FamilyModel:
    """Families with their code index and applicants, as plans."""
    fam = rollup(score(patents))
    codes = cpc_index(fam, cpc_titles)
    by_family = applicant_family(fam)
    return FamilyModel(fam, codes, with_cpc_titles(fam, codes), by_family, applicant_candidates(by_family))


def store_family_model(spark: SparkSession, patents: DataFrame, cpc_titles: DataFrame, path: str) -> FamilyModel:
    """Write the tables one after another, each derived table from the stored one it needs."""

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    fam = store(rollup(score(patents)), "families")
    codes = store(cpc_index(fam, cpc_titles), "codes")
    titled = store(with_cpc_titles(fam, codes), "titled")
    by_family = store(applicant_family(fam), "applicants_by_family")
    return FamilyModel(fam, codes, titled, by_family, store(applicant_candidates(by_family), "candidates"))
