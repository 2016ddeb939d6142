"""Stable identifiers and configuration keys."""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.fixed_values import DEFAULT_HYPERPARAMS


def stable_question_id(topic: Column, subtopic: Column, exercise: Column, index: Column) -> Column:
    """First 12 hex digits of the md5 of the four parts joined by a pipe."""
    seed = F.concat_ws(
        "|",
        F.coalesce(topic, F.lit("")),
        F.coalesce(subtopic, F.lit("")),
        F.coalesce(exercise, F.lit("")),
        index.cast("string"),
    )
    return F.substring(F.md5(seed), 1, 12)


def id_to_uuid(short_id: Column) -> Column:
    """Right-pad a hex id with zeros to 32 digits and cut it in 8-4-4-4-12."""
    padded = F.rpad(short_id, 32, "0")
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(padded, start, size) for start, size in cuts])


def uuid_to_id(uuid: Column) -> Column:
    """The 12-digit id a padded UUID was made from."""
    return F.substring(F.replace(uuid, F.lit("-"), F.lit("")), 1, 12)


TEXT_PARAMS = ["system_prompt_style"]


def with_overrides(df: DataFrame, params: str) -> tuple[DataFrame, dict[str, Column]]:
    """JSON text of every known parameter in a stored configuration, null where it is missing.

    The text is parsed once per row.
    """
    names = list(DEFAULT_HYPERPARAMS)
    parsed = df.select("*", F.json_tuple(params, *names).alias(*[f"__{n}" for n in names]))
    values = {n: F.col(f"__{n}") for n in names}
    for name in TEXT_PARAMS:
        values[name] = F.concat(F.lit('"'), values[name], F.lit('"'))
    return parsed, values


def with_hyperparam_hash(df: DataFrame, params: str = "hyperparams") -> DataFrame:
    """Add the hash of the stored configuration with all defaults filled in."""
    parsed, values = with_overrides(df, params)
    return parsed.select(*df.columns, hyperparam_hash(values).alias("hyperparam_hash"))


def canonical_json(overrides: dict[str, Column]) -> Column:
    """Key-sorted JSON text of the defaults with overrides on top, ', ' and ': ' between its parts.

    Overrides are columns of JSON text; a null leaves the default. The keys are
    fixed, so the text is one concatenation.
    """
    pieces = []
    for name in sorted(DEFAULT_HYPERPARAMS):
        default = F.lit(DEFAULT_HYPERPARAMS[name])
        value = F.coalesce(overrides[name], default) if name in overrides else default
        pieces += [F.lit((", " if pieces else "{") + f'"{name}": '), value]
    return F.concat(*pieces, F.lit("}"))


def hyperparam_hash(overrides: dict[str, Column]) -> Column:
    """First 16 hex digits of the sha256 of the full configuration."""
    return F.substring(F.sha2(canonical_json(overrides), 256), 1, 16)


def config_text(overrides: dict[str, str]) -> str:
    """The canonical text of one configuration of a request."""
    merged = {**DEFAULT_HYPERPARAMS, **overrides}
    return "{" + ", ".join(f'"{name}": {merged[name]}' for name in sorted(merged)) + "}"


def config_digest(overrides: dict[str, str]) -> str:
    """The hash of one configuration of a request."""
    return hashlib.sha256(config_text(overrides).encode()).hexdigest()[:16]
