"""Model responses to analysis records."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import bind, strip
from faultline.schema import ANALYSIS

_JSON_FENCE, _FENCE = "```json", "```"
_READ = (
    "problem_type string, possible_causes array<string>, risk_level string,"
    " suggested_commands array<map<string,string>>, confidence string"
)

#: Members that are more than a text, with the type they are read as.
_TYPES = {
    "possible_causes": "array<variant>",
    "suggested_commands": "array<map<string,variant>>",
    "confidence": "double",
}

# What an absent member means
DEFAULTS = {
    "problem_type": "未知",
    "risk_level": "P2",
    "confidence": 0.5,
    "category": "其他",
    "description": "",
    "command": "",
}


class DecodedResponses(NamedTuple):
    """``analyses``: the input's key columns with the ANALYSIS columns; ``failures``: the rest."""

    analyses: DataFrame
    failures: DataFrame


def json_text(content: Column) -> Column:
    """The JSON part of a response: inside a json fence, else inside a plain fence, else all."""
    def fenced(mark: str) -> Column:
        return strip(F.split_part(F.split_part(content, F.lit(mark), F.lit(2)),
                                  F.lit(_FENCE), F.lit(1)))

    return (
        F.when(content.contains(_JSON_FENCE), fenced(_JSON_FENCE))
        .when(content.contains(_FENCE), fenced(_FENCE))
        .otherwise(content)
    )


def decode_responses(responses: DataFrame, content: str = "content") -> DecodedResponses:
    """Read the model's answers. Text that is no JSON object is a failure (``bad_json``), and so is
    an object with a member of the wrong type (``bad_member``).

    A member that is present but null stays NULL; only absent members take their default.
    """
    others = [c for c in responses.columns if c != content]
    df = bind(responses, "_json", json_text(F.col(content)))
    # NULL unless the text is one well-formed object.
    ends = strip(F.col("_json")).endswith("}")
    df = bind(df, "_keys", F.when(ends, F.json_object_keys("_json")))
    failures = df.filter(F.col("_keys").isNull()).select(
        *others, content, F.lit("bad_json").alias("reason")
    )
    # A member that is there, is not null and cannot be read as its type spoils the answer.
    read = df.filter(F.col("_keys").isNotNull()).withColumn("_v", F.try_parse_json("_json"))
    wrong = reduce(or_, [
        F.get_json_object("_json", f"$.{name}").isNotNull()
        & F.try_variant_get("_v", f"$.{name}", kind).isNull()
        for name, kind in _TYPES.items()
    ])
    read = bind(read, "_wrong", F.coalesce(wrong, F.lit(False)))
    failures = failures.unionByName(read.filter("_wrong").select(
        *others, content, F.lit("bad_member").alias("reason")
    ))
    read = read.filter("NOT _wrong").withColumn("_r", F.from_json("_json", _READ))

    def member(name: str, value: Column, default: Column) -> Column:
        return F.when(F.array_contains("_keys", name), value).otherwise(default)

    def command(item: Column) -> Column:
        def text(name: str) -> Column:
            known = F.map_contains_key(item, name)
            return F.when(known, F.element_at(item, F.lit(name))).otherwise(DEFAULTS[name])

        return F.struct(*[text(n).alias(n) for n in ("category", "description", "command")])

    commands = F.coalesce(F.transform(F.col("_r.suggested_commands"), command), F.array())
    values = {
        "problem_type": member(
            "problem_type", F.col("_r.problem_type"), F.lit(DEFAULTS["problem_type"])
        ),
        "possible_causes": F.coalesce(F.col("_r.possible_causes"), F.array()),
        "risk_level": member(
            "risk_level", F.col("_r.risk_level"), F.lit(DEFAULTS["risk_level"])
        ),
        "suggested_commands": commands,
        "confidence": member(
            "confidence", F.col("_r.confidence").try_cast("double"),
            F.lit(DEFAULTS["confidence"]),
        ),
    }
    analyses = read.select(
        *others, *[values[f.name].cast(f.dataType).alias(f.name) for f in ANALYSIS.fields]
    )
    return DecodedResponses(analyses, failures)


def suggested_commands(analyses: DataFrame, key: str = "source") -> DataFrame:
    """``key, command_idx, category, description, command``: one row per suggestion."""
    return analyses.select(
        key, F.posexplode("suggested_commands").alias("command_idx", "_c")
    ).select(key, "command_idx", "_c.category", "_c.description", "_c.command")


def commands_by_category(suggestions: DataFrame, key: str = "source") -> DataFrame:
    """Suggestions with ``category_rank``: categories in the order in which they first appear."""
    firsts = suggestions.groupBy(key, "category").agg(F.min("command_idx").alias("category_first"))
    return suggestions.join(firsts, [key, "category"]).select(
        key, "category_first", "category", "command_idx", "description", "command"
    )
