from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowtide import FieldSpec, SyncJob, TableSpec
from rowtide.plans.jobs import run

XML = """<configuration><system><group><types>
 <type value="orders" apptype="db_bj" desc="copy orders">
  <sourcedb>left</sourcedb><targetdb>right</targetdb>
  <sourcetemptable>LOG_A</sourcetemptable>
  <maxrecords>500</maxrecords><interval>7</interval><isactive>true</isactive>
  <tables>
   <table value="child" dest="child2"><flag before="0" after="1">done</flag>
    <seqnumber>2</seqnumber><onlyinsert>true</onlyinsert>
    <fields>
     <field value="id" dest="k"><IS_PK>true</IS_PK><COLUMN_SIZE>22</COLUMN_SIZE>
      <DB_TYPE>NUMBER</DB_TYPE><JDBC_TYPE>NUMERIC</JDBC_TYPE><IS_NULL>false</IS_NULL></field>
     <field value="at" dest="t"><IS_PK>true</IS_PK><COLUMN_SIZE>7</COLUMN_SIZE>
      <DB_TYPE>DATE</DB_TYPE><JDBC_TYPE>DATE</JDBC_TYPE><IS_NULL>true</IS_NULL></field>
    </fields></table>
   <table value="parent" dest="parent"><seqnumber>1</seqnumber>
    <deleteenable>true</deleteenable><deletesource>true</deletesource><onlyonce>true</onlyonce>
    <fields>
     <field value="id" dest="id"><IS_PK>true</IS_PK><COLUMN_SIZE>22</COLUMN_SIZE>
      <DB_TYPE>NUMBER</DB_TYPE><JDBC_TYPE>BIGINT</JDBC_TYPE><IS_NULL>false</IS_NULL></field>
    </fields></table>
  </tables>
  <sequences><sequence value="s1" dest="s2"/></sequences>
 </type>
 <type value="other" apptype="db_qb" desc=""><tables/></type>
</types></group></system></configuration>"""


def test_xml_job():
    job = SyncJob.from_xml(XML, "orders")
    assert (job.apptype, job.source_db, job.target_db) == ("db_bj", "left", "right")
    assert (job.source_log, job.target_log) == ("LOG_A", None)
    assert (job.max_records, job.interval, job.active) == (500, 7, True)
    assert [[t.source for t in stage] for stage in job.stages()] == [["parent"], ["child"]]
    assert job.dependent
    child, parent = job.tables
    assert (child.flag.name, child.flag.before, child.flag.after) == ("done", 0, 1)
    assert child.insert_only and not child.target_deletable
    assert parent.target_deletable and parent.delete_source and parent.only_once
    assert child.pk == ["id", "at"] and child.target_pk == ["k", "t"]
    assert child.marker_column == "at"
    assert child.fields[1].spark_type == "timestamp_ntz"
    assert [(s.source, s.target) for s in job.sequences] == [("s1", "s2")]
    with pytest.raises(ValueError):
        SyncJob.from_xml(XML)


def test_bad_specs():
    one = {"source": "a", "pk": True}
    with pytest.raises(ValueError, match="no columns"):
        TableSpec.from_dict({"source": "t", "fields": []})
    with pytest.raises(ValueError, match="twice"):
        TableSpec.from_dict({"source": "t", "fields": [one, one]})
    with pytest.raises(ValueError, match="not supported"):
        TableSpec.from_dict({"source": "t", "fields": [one | {"jdbc_type": "REF"}]})
    with pytest.raises(ValueError, match="no marker"):
        TableSpec("t", "t", (FieldSpec("a", "a", True),)).marker_column  # noqa: B018


def test_check_finds_missing_and_ambiguous(spark):
    spec = TableSpec("t", "t", (FieldSpec("id", "id", True), FieldSpec("b", "b")))
    spec.check(spark.range(1).withColumn("b", F.lit(1)))
    with pytest.raises(ValueError, match=r"missing columns \['b'\]"):
        spec.check(spark.range(1))
    with pytest.raises(ValueError, match=r"ambiguous columns \['b'\]"):
        spec.check(spark.range(1).select("id", F.lit(1).alias("b"), F.lit(2).alias("b")))


def test_schema_and_sizes():
    spec = TableSpec(
        "t",
        "t",
        (
            FieldSpec("a", "x", True, "NUMERIC", size="12,2"),
            FieldSpec("b", "y", False, "no such type"),
            FieldSpec("c", "z", False, "DECIMAL", size="9"),
        ),
    )
    assert spec.schema().simpleString() == "struct<x:decimal(12,2),y:string,z:decimal(38,10)>"
    assert spec.reversed().pk == ["x"]


def test_unknown_mode_raises():
    with pytest.raises(ValueError, match="unknown mode"):
        run(SyncJob(name="j", apptype="sip"), None, None)
