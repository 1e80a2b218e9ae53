"""A corpus design made by rule, with the size of a real one: six dialects, ten tools, twenty forms, ten no-call intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table

DIALECTS = ["msa", "egyptian", "levantine", "gulf", "iraqi", "maghrebi"]
TOOLS, VALUES, FORMS, IDLE = 10, 10, 20, 10
HELD_OUT = [1, 4]


def tool_name(i: int) -> str:
    return f"look_up_{i:02d}"


def made_design() -> dict:
    """Texts are numbered placeholders; the last field of each third tool is a date."""
    tasks = []
    for i in range(TOOLS):
        dated = i % 3 == 0
        tasks.append(
            {
                "tool": tool_name(i),
                "description": f"أداة {i}",
                "fields": ["subject", "number", "visit_date_iso" if dated else "place"],
                "types": ["string", "integer", "string"],
                "labels": ["موضوع", "عدد", "تاريخ" if dated else "مكان"],
                "request_subject": "شيء {value}",
                "place": f"دار {i}",
                "values": [[f"موضوع {i} {v}", v + 3, f"2027-{v + 1:02d}-{v + 5:02d}" if dated else f"مكان {v}"] for v in range(VALUES)],
                **({"linked_fields": ["subject", "number"]} if i == 2 else {}),
            }
        )
    return _with_prompts(DIALECTS, tasks, [tool_name(i) for i in HELD_OUT], {"train": tool_name(2), "validation": tool_name(HELD_OUT[1])})


def _with_prompts(dialects: list[str], tasks: list[dict], held_out: list[str], relevant: dict[str, str]) -> dict:
    """Numbered placeholders as prompts and no-call requests."""
    forms = {d: [f"{d} {f}: " + "{subject} في {place}؛ {details}." for f in range(FORMS)] for d in dialects}
    no_call = {
        "tasks": [{"domain": "missing_required_input" if t == 0 else "out_of_scope" if t == 1 else f"chat_{t}", "answer": "جواب {slot}"} for t in range(IDLE)],
        "values": [[{"slot": f"قيمة {t} {f}"} for f in range(10)] for t in range(IDLE)],
        "forms": {d: [f"{d} {f}: " + "{request}." for f in range(10)] for d in dialects},
        "requests": {d: [f"طلب {t} " + "{slot}" + ("؟" if t % 2 else "") for t in range(IDLE)] for d in dialects},
        "missing_domain": "missing_required_input",
        "missing_requests": {s: {d: "ابحث {slot}" for d in dialects} for s in ("train", "validation")},
        "missing_answers": {s: {d: "أين ومتى؟" for d in dialects} for s in ("train", "validation")},
        "out_of_scope_domain": "out_of_scope",
        "out_of_scope_answers": {d: "لا أداة لهذا: {slot}" for d in dialects},
        "relevant": relevant,
        "held_out_from": 8,
    }
    return {"dialects": dialects, "prompt_forms": forms, "tasks": tasks, "validation_tools": held_out, "no_call": no_call}


def table_design(spark: SparkSession, sf_dir: str) -> dict:
    """A design out of tables: regions are dialects, nations are tools (every third with a date), and the values of a tool's fields are those of the orders whose customer falls to it. Of one tool two fields are linked."""
    regions = [r.r_name for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    nations = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # the tools of a design
    tasks = [{"tool": n.lower(), "description": f"أداة {n}", "fields": ["customer", "number", "visit_date_iso" if i % 3 == 0 else "priority"], "types": ["string", "integer", "string"], "labels": ["زبون", "عدد", "تاريخ" if i % 3 == 0 else "درجة"], "request_subject": "شيء {value}", "place": f"دار {n}"} for i, n in enumerate(nations)]
    design = _with_prompts(regions, tasks, [tasks[i]["tool"] for i in HELD_OUT], {"train": tasks[2]["tool"], "validation": tasks[HELD_OUT[1]]["tool"]})
    return design | {"tables": (spark.createDataFrame([(t, i, f, task["labels"][i], t == 2 and i < 2) for t, task in enumerate(tasks) for i, f in enumerate(task["fields"])], "task int, at int, name string, label string, linked boolean"), _order_values(spark, sf_dir, len(tasks)))}


def _order_values(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    task = (F.col("o_custkey") % tasks).cast("int")
    last = F.when(task % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    texts = [F.concat(F.lit("c"), F.col("o_custkey").cast("string")), (F.col("o_orderkey") % 11).cast("string"), last]
    quoted = lambda i, t: t if i == 1 else F.concat(F.lit('"'), t, F.lit('"'))
    cells = F.array(*[F.struct(F.lit(i).alias("at"), t.alias("text"), quoted(i, t).alias("json")) for i, t in enumerate(texts)])
    return table(spark, sf_dir, "orders").select(task.alias("task"), F.col("o_orderkey").alias("nth"), F.explode(cells).alias("c")).select("task", "nth", "c.*")
