"""Registered queries of files and objects: each writes what it then reads back, under the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .plans.fixtures import tasks_for, view
from .queries import _query, c
from .queries_streaming import _folder
from .sources.lines import read_lines
from .sources.objects import outcomes, write_objects

#: A document as a line; what a line may not hold as it is, is written as JSON has it. A carriage return may stay.
_LINE = "concat('{\"id\":', cast(doc_id as %s), ',\"text\":\"', replace(replace(replace(coalesce(text, ''), chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), chr(10), concat(chr(92), 'n')), '\"', case when doc_id %% 7 = 0 then chr(13) else '' end, '}')"
#: Documents to a file.
_FILE_DOCS = 5000


@_query(
    f"with l as (select doc_id // {_FILE_DOCS} as part, doc_id, {_LINE % 'varchar'} as line from documents where doc_id is not null) "
    "select part, row_number() over w - 1 as ordinal, cast(coalesce(sum(strlen(line) + 1) over (partition by part order by doc_id, line rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", "
    "strlen(line) + 1 as length, sha256(line) as sha256 from l window w as (partition by part order by doc_id, line)"
)
def jsonl_lines(spark, sf):
    """Files of documents, read back by byte ranges with true ordinals and offsets."""
    folder = _folder(spark, "lines")
    docs = view(spark, sf, "documents").filter("doc_id is not null").select(F.expr(f"doc_id div {_FILE_DOCS}").alias("part"), "doc_id", F.expr(_LINE % "string").alias("line"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id", "line").select("part", "line").write.partitionBy("part").option("lineSep", "\n").text(folder)
    lines = read_lines(spark, folder)
    return lines.select(F.regexp_extract("path", "/part=([0-9]+)/", 1).cast("long").alias("part"), "ordinal", "offset", "length", F.sha2("line", 256).alias("sha256"))


#: An answer as a line of its supplier's object, and what is left out or changed when deliveries come again.
_ANSWER = "concat(batch_id, ' ', custom_id, ' ', cast(arrival as %s), ' ', coalesce(cast(status_code as %s), ''))"
_AGAIN = "case when s % 10 = 0 then concat(line, ' again') else line end"
_MOST_LINES = 620


@_query(
    f"with l as (select concat('results/supplier-', cast(s as varchar), '.jsonl') as object, s, batch_id, ordinal, arrival, {_ANSWER.replace('%s', 'varchar')} as line from fx_deliveries), "
    f"t as (select 1 as turn, object, batch_id, ordinal, arrival, line from l union all select 2, object, batch_id, ordinal, arrival, {_AGAIN} from l), "
    "o as (select turn, object, count(*) as lines, cast(sum(strlen(line) + 1) as bigint) as bytes, sha256(string_agg(concat(line, chr(10)), '' order by batch_id, ordinal, arrival, line)) as sha256 from t group by 1, 2), "
    "n as (select o.*, case when turn = 1 or f.sha256 = o.sha256 then object else concat(left(object, length(object) - 6), '-', left(o.sha256, 16), '.jsonl') end as name from o "
    f"join (select object, sha256 from o where turn = 1) f using (object) where lines <= {_MOST_LINES}) "
    "select distinct name, lines, bytes, sha256 from n"
)
def committed_objects(spark, sf):
    """Objects of answers, delivered twice: equal ones are reused, changed ones go by their content, those beyond the limit leave nothing. Read back from the files."""
    folder = _folder(spark, "objects")
    tasks = tasks_for(view(spark, sf, "lineitem"))
    # An arrival is one row of its request, so a line's place needs no line; lines are shuffled once a turn.
    place = F.struct("batch_id", "ordinal", "arrival").alias("place")
    rows = view(spark, sf, "deliveries", by_batch=True).select(F.concat(F.lit("results/supplier-"), c("s").cast("string"), F.lit(".jsonl")).alias("object"), "s", place, F.expr(_ANSWER.replace("%s", "string")).alias("line"))
    for turn in (rows, rows.withColumn("line", F.expr(_AGAIN))):
        write_objects(turn.select("object", "place", "line"), folder, "place", most_lines=_MOST_LINES, fallback=True, tasks=tasks)
    # An object's bytes from its lines, in the order that the file has.
    lines = read_lines(spark, folder).select("path", "ordinal", "length", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.sum("length").alias("bytes"), F.sha2(text, 256).alias("sha256")).select(
        F.concat(F.lit("results/"), F.element_at(F.split("path", "/"), -1)).alias("name"), "lines", "bytes", "sha256"
    )


@_query(
    f"with l as (select concat('results/supplier-', cast(s as varchar), '.jsonl') as object, {_ANSWER.replace('%s', 'varchar')} as line from fx_deliveries), "
    "o as (select object, count(*) as lines, cast(sum(strlen(line) + 1) as bigint) as bytes from l group by 1) "
    f"select case when lines > {_MOST_LINES} then 'too_many_lines' else 'created' end as outcome, count(*) as objects, cast(sum(case when lines <= {_MOST_LINES} then lines end) as bigint) as lines, "
    f"cast(sum(case when lines <= {_MOST_LINES} then bytes end) as bigint) as bytes from o group by 1"
)
def object_outcomes(spark, sf):
    folder = _folder(spark, "objects")
    rows = view(spark, sf, "deliveries").select(F.concat(F.lit("results/supplier-"), c("s").cast("string"), F.lit(".jsonl")).alias("object"), F.struct("batch_id", "ordinal", "arrival").alias("place"), F.expr(_ANSWER.replace("%s", "string")).alias("line"))
    write_objects(rows, folder, "place", most_lines=_MOST_LINES)
    return outcomes(spark, folder).groupBy("outcome").agg(F.count("*").alias("objects"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
