"""Declarative description of a synchronisation job."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowtide.functions.types import UNSUPPORTED, normalise_jdbc, spark_type


def _flag(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    return str(value or "").strip().lower() in ("true", "1", "y", "yes")


@dataclass(frozen=True)
class FieldSpec:
    """One mapped column: its name on both sides, its type and key membership."""

    source: str
    target: str
    pk: bool = False
    jdbc_type: str = "VARCHAR"
    db_type: str = ""
    size: str = ""
    nullable: bool = True

    @property
    def spark_type(self) -> str:
        return spark_type(self.jdbc_type, self.size)

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> FieldSpec:
        source = d["source"]
        return cls(
            source=source,
            target=d.get("target", source),
            pk=_flag(d.get("pk", False)),
            jdbc_type=d.get("jdbc_type", "VARCHAR"),
            db_type=d.get("db_type", ""),
            size=str(d.get("size", "")),
            nullable=_flag(d.get("nullable", True)),
        )


@dataclass(frozen=True)
class FlagSpec:
    """The flag column of a marker job and its values before and after copying."""

    name: str
    before: int
    after: int


@dataclass(frozen=True)
class SequenceSpec:
    source: str
    target: str


@dataclass(frozen=True)
class TableSpec:
    """A source/target pair with its column mapping and policies."""

    source: str
    target: str
    fields: tuple[FieldSpec, ...]
    seqnumber: int = 0
    flag: FlagSpec | None = None
    marker: str | None = None
    insert_only: bool = False
    target_deletable: bool = False
    delete_source: bool = False
    only_once: bool = False
    clob_null_to_empty: bool = False

    def __post_init__(self) -> None:
        if not self.fields:
            raise ValueError(f"table {self.source}: no columns are mapped")
        for side in ("source", "target"):
            names = [getattr(f, side).lower() for f in self.fields]
            twice = sorted({n for n in names if names.count(n) > 1})
            if twice:
                raise ValueError(f"table {self.source}: {side} columns mapped twice: {twice}")
        for f in self.fields:
            if normalise_jdbc(f.jdbc_type) in UNSUPPORTED:
                raise ValueError(f"column {f.source}: type {f.jdbc_type} is not supported")

    @property
    def pk(self) -> list[str]:
        """Key columns by their source names."""
        return [f.source for f in self.fields if f.pk]

    @property
    def target_pk(self) -> list[str]:
        """Key columns by their target names."""
        return [f.target for f in self.fields if f.pk]

    @property
    def marker_column(self) -> str:
        """The timestamp column of a date-marker job.

        Declared as ``marker``; a spec that predates that setting falls back to
        its last key column, if that one is a date or timestamp.
        """
        if self.marker:
            return self.marker
        keys = [f for f in self.fields if f.pk]
        if keys and normalise_jdbc(keys[-1].jdbc_type) in ("DATE", "TIMESTAMP"):
            return keys[-1].source
        raise ValueError(f"table {self.source}: no marker column is declared")

    def schema(self, side: str = "target") -> T.StructType:
        """The mapped columns as a Spark schema, by source or target names."""
        return T.StructType(
            [
                T.StructField(getattr(f, side), T.DataType.fromDDL(f.spark_type), f.nullable)
                for f in self.fields
            ]
        )

    def check(self, df: DataFrame, side: str = "source") -> None:
        """Fail early if a mapped column is missing from ``df`` or ambiguous in it."""
        have = [c.lower() for c in df.columns]
        wanted = [getattr(f, side) for f in self.fields]
        if side == "source" and self.flag:
            wanted.append(self.flag.name)
        missing = [c for c in wanted if c.lower() not in have]
        ambiguous = [c for c in wanted if have.count(c.lower()) > 1]
        if missing or ambiguous:
            raise ValueError(
                f"table {self.source}: missing columns {missing}, ambiguous columns {ambiguous}"
            )

    def reversed(self) -> TableSpec:
        """The same pair seen from the target side."""
        return TableSpec(
            source=self.target,
            target=self.source,
            fields=tuple(
                FieldSpec(f.target, f.source, f.pk, f.jdbc_type, f.db_type, f.size, f.nullable)
                for f in self.fields
            ),
            seqnumber=self.seqnumber,
            insert_only=self.insert_only,
            target_deletable=self.target_deletable,
            clob_null_to_empty=self.clob_null_to_empty,
        )

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> TableSpec:
        source = d["source"]
        flag = d.get("flag")
        return cls(
            source=source,
            target=d.get("target", source),
            fields=tuple(FieldSpec.from_dict(f) for f in d["fields"]),
            seqnumber=int(d.get("seqnumber", 0)),
            flag=FlagSpec(flag["name"], int(flag["before"]), int(flag["after"])) if flag else None,
            marker=d.get("marker"),
            insert_only=_flag(d.get("insert_only")),
            target_deletable=_flag(d.get("target_deletable")),
            delete_source=_flag(d.get("delete_source")),
            only_once=_flag(d.get("only_once")),
            clob_null_to_empty=_flag(d.get("clob_null_to_empty")),
        )


@dataclass(frozen=True)
class SyncJob:
    """One job: its mode, its two databases, and the tables or sequences it covers."""

    name: str
    apptype: str
    source_db: str = "source"
    target_db: str = "target"
    source_log: str | None = None
    target_log: str | None = None
    max_records: int | None = None
    interval: int = 1
    active: bool = True
    description: str = ""
    tables: tuple[TableSpec, ...] = ()
    sequences: tuple[SequenceSpec, ...] = field(default=())

    def stages(self) -> list[list[TableSpec]]:
        """Tables grouped by order number, lowest first.

        More than one group makes the job a dependent one: its groups run one
        after the other, the tables inside a group side by side.
        """
        ordered = sorted(self.tables, key=lambda t: t.seqnumber)
        return [list(g) for _, g in groupby(ordered, key=lambda t: t.seqnumber)]

    @property
    def dependent(self) -> bool:
        return len({t.seqnumber for t in self.tables}) > 1

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> SyncJob:
        return cls(
            name=d["name"],
            apptype=d["apptype"],
            source_db=d.get("source_db", "source"),
            target_db=d.get("target_db", "target"),
            source_log=d.get("source_log"),
            target_log=d.get("target_log"),
            max_records=int(d["max_records"]) if d.get("max_records") else None,
            interval=int(d.get("interval", 1)),
            active=_flag(d.get("active", True)),
            description=d.get("description", ""),
            tables=tuple(TableSpec.from_dict(t) for t in d.get("tables", ())),
            sequences=tuple(
                SequenceSpec(s["source"], s.get("target", s["source"]))
                for s in d.get("sequences", ())
            ),
        )

    @classmethod
    def from_xml(cls, text: str, name: str | None = None) -> SyncJob:
        """Read the job called ``name`` (or the only one) from an XML job file."""
        jobs = [n for n in ET.fromstring(text).iter("type") if n.get("value")]
        if name is not None:
            jobs = [n for n in jobs if n.get("value") == name]
        if len(jobs) != 1:
            raise ValueError(f"expected one job {name or ''}, found {len(jobs)}")
        node = jobs[0]
        return cls.from_dict(
            {
                "name": node.get("value"),
                "apptype": node.get("apptype"),
                "description": node.get("desc", ""),
                "source_db": node.findtext("sourcedb", "source"),
                "target_db": node.findtext("targetdb", "target"),
                "source_log": node.findtext("sourcetemptable"),
                "target_log": node.findtext("targettemptable"),
                "max_records": node.findtext("maxrecords"),
                "interval": node.findtext("interval", "1"),
                "active": node.findtext("isactive", "true"),
                "tables": [_table_dict(t) for t in node.iterfind("tables/table")],
                "sequences": _pairs(node.iterfind("sequences/sequence")),
            }
        )


def _pairs(nodes: Iterable[ET.Element]) -> list[dict[str, str]]:
    return [{"source": n.get("value"), "target": n.get("dest", n.get("value"))} for n in nodes]


def _table_dict(node: ET.Element) -> dict[str, Any]:
    flag = node.find("flag")
    return {
        "source": node.get("value"),
        "target": node.get("dest", node.get("value")),
        "seqnumber": node.findtext("seqnumber", "0"),
        "flag": None
        if flag is None
        else {
            "name": (flag.text or "").strip(),
            "before": flag.get("before"),
            "after": flag.get("after"),
        },
        "marker": node.findtext("marker"),
        "insert_only": node.findtext("onlyinsert"),
        "target_deletable": node.findtext("deleteenable"),
        "delete_source": node.findtext("deletesource"),
        "only_once": node.findtext("onlyonce"),
        "fields": [
            {
                "source": f.get("value"),
                "target": f.get("dest", f.get("value")),
                "pk": f.findtext("IS_PK"),
                "size": f.findtext("COLUMN_SIZE", ""),
                "db_type": f.findtext("DB_TYPE", ""),
                "jdbc_type": f.findtext("JDBC_TYPE", "VARCHAR"),
                "nullable": f.findtext("IS_NULL", "true"),
            }
            for f in node.iterfind("fields/field")
        ],
    }
