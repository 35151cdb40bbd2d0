"""Rule packs: how to recognise a kind of document and what its columns are."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from doctables.operators.schema import Field

GENERIC = "generic_table"


@dataclass(frozen=True)
class Profile:
    name: str
    display_name: str = ""
    document_type: str = "STRUCTURED_TABLE"
    recommended_extractor: str = "pdf_tables"
    filename_regex: str | None = None
    keywords: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    datasets: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def primary_key(self) -> tuple[str, ...]:
        return self.datasets[0][1] if self.datasets else ()


def profile_from(data: Mapping) -> Profile:
    """Profile from the nested form that rule-pack files use."""
    patterns = data.get("matching_patterns") or {}
    return Profile(
        name=data["name"],
        display_name=data.get("display_name", data["name"]),
        document_type=data.get("document_type", "STRUCTURED_TABLE"),
        recommended_extractor=data.get("recommended_extractor", "pdf_tables"),
        filename_regex=patterns.get("filename_regex"),
        keywords=tuple(patterns.get("keywords") or ()),
        fields=tuple(
            Field(
                name=c["name"],
                display_name=c.get("display_name", c["name"]),
                data_type=str(c.get("type", "string")).upper(),
                required=bool(c.get("required", False)),
                pattern=c.get("pattern"),
                min_value=c.get("min_value"),
                max_value=c.get("max_value"),
                aliases=tuple(c.get("aliases") or ()),
            )
            for c in data.get("columns") or ()
        ),
        datasets=tuple(
            (d["id"], tuple(d.get("primary_key") or ())) for d in data.get("datasets") or ()
        ),
    )


def load_profiles(folder: str) -> list[Profile]:
    """Profiles of a folder of YAML or JSON files in name order; bad files are skipped."""
    out = []
    for path in sorted(Path(folder).glob("*")):
        try:
            if path.suffix == ".json":
                data = json.loads(path.read_text(encoding="utf-8"))
            elif path.suffix in (".yaml", ".yml"):
                import yaml

                data = yaml.safe_load(path.read_text(encoding="utf-8"))
            else:
                continue
            out.append(profile_from(data))
        except Exception as error:  # noqa: BLE001 - a bad file must not stop the others
            print(f"profile {path.name} skipped: {error}")
    return out


def get_profile(profiles: Sequence[Profile], name: str) -> Profile | None:
    return next((p for p in profiles if p.name == name), None)


def profile_fields_frame(spark: SparkSession, profiles: Sequence[Profile]) -> DataFrame:
    """Aliases as a table (profile, field, alias in lower case); a few rows per profile."""
    rows = [
        (p.name, f.name, text.lower())
        for p in profiles
        for f in p.fields
        for text in dict.fromkeys((f.name, f.display_name, *f.aliases))
    ]
    return spark.createDataFrame(rows, "profile string, field string, alias string")
