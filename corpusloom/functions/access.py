"""Access classes: the restrictiveness lattice and who may see what."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access classes from least to most restrictive.
ACCESS = ["open_access", "metadata_only", "licensed_future", "unknown", "user_supplied_private"]
SHAREABLE = ["open_access", "metadata_only"]
# Authority of what an edge or a claim rests on, from least to most.
PROVENANCE = ["provider_reference", "parsed_bibliography", "manual_override"]
EPISTEMIC = ["llm_inferred", "llm_extracted", "metadata_resolved", "deterministic", "user_supplied", "user_validated"]


def rank_in(value: Column | str, order: list[str], other: int | None = None) -> Column:
    """1-based place of ``value`` in ``order``; null stays null, values not listed are ``other``."""
    c = F.col(value) if isinstance(value, str) else value
    at = F.array_position(F.array(*[F.lit(x) for x in order]), c)
    return F.when(c.isNull(), None).when(at > 0, at).otherwise(F.lit(other)).cast("int")


def named(rank: Column, order: list[str]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in order]), rank.cast("int"))


def access_rank(value: Column | str, null_is_private: bool = False) -> Column:
    """A class not in the lattice counts as private; so does null, if asked."""
    c = F.col(value) if isinstance(value, str) else value
    if null_is_private:
        c = F.when(c.isNull() | c.isin("", "unknown"), F.lit(ACCESS[-1])).otherwise(c)
    return rank_in(c, ACCESS, len(ACCESS))


def most_restrictive(value: Column | str, null_is_private: bool = False) -> Column:
    """Aggregate: the most restrictive class of a group; a group without any is private."""
    return named(F.coalesce(F.max(access_rank(value, null_is_private)), F.lit(len(ACCESS))), ACCESS)


def shareable(value: Column | str) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(c.isin(*SHAREABLE), F.lit(False))
