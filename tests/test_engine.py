"""Sources, functions, materialisation, streams and the command line."""

import datetime
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conceptra.engine import Engine
from conceptra.functions.procedural import Interpreter, returned_type
from conceptra.lang import errors as E
from conceptra.lang.model import Model
from conceptra.lang.parser import parse_expression, parse_program


@pytest.fixture
def things(spark):
    return spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (3, None, -1.5), (3, None, -1.5)], "id int, name string, v double")


THINGS = 'datasource t (id, name, v) from PARQUET file "t.parquet";'


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind, options", [("CSV", ""), ("JSON", ""), ("PARQUET", ""), ("ORC", ""), ("XML", ""), ("CSV", '@Source(delimiter = ";") ')])
def test_formats(spark, things, tmp_path, kind, options):
    writer = things.write.option("header", True).option("rowTag", "row")
    (writer.option("delimiter", ";") if options else writer).format(kind.lower()).save(str(tmp_path / "t"))
    for types in ("v, id", "float v, int id"):
        e = Engine(spark, f'{options}datasource t ({types}) from {kind} file "t"; concept r is t where id > 1;', base=str(tmp_path))
        assert rows(e.concept("r")) == rows(things.filter("id > 1").select("v", "id"))


def test_avro_is_refused_clearly(spark, tmp_path):
    with pytest.raises(E.Unsupported, match="AVRO"):
        Engine(spark, 'datasource t (id) from AVRO file "t";', base=str(tmp_path)).concept("t")


def test_missing_columns(spark, things):
    with pytest.raises(E.NotFound):
        Engine(spark, 'datasource t (id, other) from CSV file "t";', sources={"t": things}).concept("t")


def test_empty_tables_and_nulls(spark, things):
    text = THINGS + "concept cube c metrics (n = count(), s = sum(v)) dimensions (name) from t; concept u union of c, c; concept w (id, r = rank() over (order by (v asc))) from t;"
    e = Engine(spark, text, sources={"t": things})
    assert rows(e.concept("c")) == [(1, 2.5, "a"), (1, None, "b"), (2, -3.0, None)]
    empty = Engine(spark, text, sources={"t": things.limit(0)})
    assert rows(empty.concept("u")) == [] and rows(empty.concept("w")) == []


def test_quantified_comparisons_with_nulls(spark, things):
    e = Engine(spark, THINGS, sources={"t": things})
    assert rows(e.query("(id) from t where v >= all <(v) from t q>")) == []
    assert rows(e.query("(id) from t where v >= all <(v) from t q where q.v != Null>")) == [(1,)]
    assert rows(e.query("(id) from t where v > any <(v) from t q>")) == [(1,)]
    got = rows(e.query("(id, a = v > all <(v) from t q>, o = v >= any <(v) from t q>) from t where id < 3"))
    assert got == [(1, False, True), (2, None, None)]
    assert rows(e.query("(id) from t where unique <(name) from t q (id = t.id)>")) == [(1,), (2,), (3,), (3,)]
    assert rows(e.query("(id) from t where unique <(v) from t q (id = t.id)>")) == [(1,), (2,)]


def test_associativity(spark, things):
    text = THINGS + "concept r (id, x = 10 - id - 1) from t;"
    assert rows(Engine(spark, text, sources={"t": things}).concept("r"))[0] == (1, 10)
    assert rows(Engine(spark, Model.parse(text, associativity="left"), sources={"t": things}).concept("r"))[0] == (1, 8)


def test_strings_are_quoted(spark, things):
    e = Engine(spark, THINGS, sources={"t": things})
    assert e.query("(s = \"it's \\n\") from t limit 1").first()[0] == "it's \\n"


def test_current_functions(spark, things):
    row = Engine(spark, THINGS, sources={"t": things}).query("(d = current_date(), ts = current_timestamp(), x = current_time()) from t limit 1").first()
    assert row.d is not None and row.ts is not None and row.x is not None


def test_registered_functions(spark, things):
    e = Engine(spark, THINGS, sources={"t": things})
    e.register("twice", lambda x: None if x is None else x * 2.0)
    assert rows(e.query("(id, w = twice(v)) from t where id < 3")) == [(1, 5.0), (2, None)]


@pytest.mark.parametrize("body, args, value", [
    ("{ var s = 0; for (var i = 1; i <= n; i++) { if i = 3 then { continue }; if i > 5 then { break }; s = s + i }; return s }", [10], 12),
    ("{ var l; for (x in [1, 2, 3]) { l[] = x * n }; return l[2] }", [10], 30), ('{ var m; m["a"] = 1; m["b"] = 2; var s = 0; for (k, v in m) { s = s + v }; return s + n }', [1], 4),
    ("{ var f = (x) => { return x + 1 }; return f(n) }", [1], 2), ("if n <= 1 then { return 1 } else { return n * f(n - 1) }", [5], 120), ("{ do { n++ } while n < 7; return n }", [1], 7),
    ("{ while n > 3 do { n-- }; return case when n = 3 then \"three\" else \"less\" }", [9], "three"), ("{ def g(x) { return x * x }; return g(n) }", [4], 16), ("{ return coalesce(Null, n + Null, 5) }", [1], 5),
])
def test_statements(body, args, value):
    (f,) = parse_program(f"def f(n) {body}")
    assert Interpreter({"f": f}).call("f", args) == value


def test_types_of_functions():
    kinds = {"{ return n + 1 }": "double", '{ return concat(n, "x") }': "string", "{ return n > 1 }": "boolean", "{ var t = 0; t++; return t }": "double"}
    for body, kind in kinds.items():
        assert returned_type(parse_program(f"def f(n) {body}")[0]) == kind


def test_incremental_runs_are_repeatable(spark, things):
    text = THINGS + '@Materialized(type = "Incremental", strategy = "{s}", uniqueKey = "id", operator = "{o}", TargetName = "{t}") concept r (id, n = count()) from t group by id;'
    for i, strategy in enumerate(["InsertDelete", "Merge", "InsertOverrideMerge"]):
        table = f"inc_{i}"
        own = text.format(s=strategy, o=">=", t=table)
        Engine(spark, own, sources={"t": things.limit(2)}).materialize()
        for _ in range(2):
            Engine(spark, own, sources={"t": things}).materialize(parse_expression("2"), full=False)
        assert rows(spark.table(table)) == [(1, 1), (2, 1), (3, 2)], strategy
        spark.sql(f"DROP TABLE {table}")


def test_equality_keeps_filtering(spark, things):
    text = THINGS + '@Materialized(type = "Incremental", uniqueKey = "id", TargetName = "inc_eq") concept r (id, n = count()) from t group by id;'
    Engine(spark, text, sources={"t": things}).materialize(parse_expression("3"), full=False)
    assert rows(spark.table("inc_eq")) == [(3, 2)]
    Engine(spark, text, sources={"t": things.limit(3)}).materialize(parse_expression("3"), full=False)
    assert rows(spark.table("inc_eq")) == [(3, 1)]
    spark.sql("DROP TABLE inc_eq")


def test_incremental_errors(spark, things):
    note = '@Materialized(type = "Incremental", {x} TargetName = "inc_err") concept r (id, v) from t;'
    spark.sql("DROP TABLE IF EXISTS inc_err")
    things.select("id", "v").write.saveAsTable("inc_err")
    for extra, value in (("", "1"), ('uniqueKey = "id",', None), ('uniqueKey = "id", operator = "between",', "1"), ('uniqueKey = "id", strategy = "Other",', "1")):
        with pytest.raises(E.ModelError):
            Engine(spark, THINGS + note.format(x=extra), sources={"t": things}).materialize(parse_expression(value) if value else None, full=False)
    with pytest.raises(E.ModelError, match="key"):
        Engine(spark, THINGS + note.format(x='uniqueKey = "id", strategy = "Merge", operator = ">",'), sources={"t": things}).materialize(parse_expression("0"), full=False)
    assert spark.table("inc_err").count() == 4
    spark.sql("DROP TABLE inc_err")


def test_streams(spark, things, tmp_path):
    from conceptra.streaming import live

    things.write.parquet(str(tmp_path / "t.parquet"))
    text = THINGS + "concept cube c metrics (n = count()) dimensions (id) from t where id > 1;"
    e = live.engine(spark, text, ["t"], base=str(tmp_path))
    frame = e.concept("c")
    assert frame.isStreaming
    q = frame.writeStream.outputMode("complete").format("memory").queryName("live_c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("live_c")) == [(1, 2), (2, 3)]


def test_refresh_from_a_stream(spark, things, tmp_path):
    from conceptra.streaming import live

    things.write.parquet(str(tmp_path / "t.parquet"))
    model = Model.parse(THINGS + '@Materialized(type = "Incremental", strategy = "Append", uniqueKey = "id", TargetName = "live_r") concept r (id, v) from t where id > 1;')
    stream = live.read(spark, model.concept("t"), str(tmp_path))
    live.refresh(spark, model, "t", stream, str(tmp_path / "check")).awaitTermination(60)
    assert spark.table("live_r").count() == 3
    spark.sql("DROP TABLE live_r")


def test_command_line(tmp_path, capsys):
    from conceptra.cli import main

    (tmp_path / "m").write_text(THINGS + "concept r (id) from t;")
    assert main(["validate", str(tmp_path / "m")]) == 0
    assert capsys.readouterr().out == "2 concepts\n"
    (tmp_path / "bad").write_text(THINGS + "concept r (q) from t;")
    assert main(["validate", str(tmp_path / "bad")]) == 1
    assert "CannotInfer" in capsys.readouterr().err


def test_command_line_queries(spark, things, tmp_path, capsys):
    from conceptra.cli import main

    things.write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "m").write_text(THINGS + '@Materialized(type = "Table", TargetName = "cli_r") concept r (id, v) from t where id = 1;')
    assert main(["query", str(tmp_path / "m"), "(id) from r"]) == 0
    assert main(["--sql", "query", str(tmp_path / "m"), "(id) from r"]) == 0
    assert main(["--explain", "query", str(tmp_path / "m"), "(id) from r"]) == 0
    assert main(["query", str(tmp_path / "m"), "(q) from r"]) == 1
    assert main(["materialize", str(tmp_path / "m")]) == 0
    out = capsys.readouterr().out
    assert "SELECT" in out and "Physical Plan" in out and "cli_r" in out
    spark.sql("DROP TABLE cli_r")


def test_the_library_does_not_need_the_optional_part():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; import conceptra.workload, conceptra.cli, conceptra.streaming.live; assert not any(m.startswith('conceptra.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_table_functions(spark, things):
    from pyspark.sql.functions import udtf

    @udtf(returnType="i: int")
    class Upto:
        def eval(self, n: int = 3):
            for i in range(n or 0):
                yield (i,)

    text = THINGS + "concept upto (i, @Input n) by count_up; concept three (i) by count_up; concept head (i, n = x.n) from upto x (n = 2); concept each (id, i) from t, upto x where x.n = t.id and i > 0;"
    e = Engine(spark, text, sources={"t": things})
    e.register_table("count_up", Upto)
    assert rows(e.query("from three")) == [(0,), (1,), (2,)]
    assert rows(e.query("from head")) == [(0, 2), (1, 2)]
    assert rows(e.query("from each")) == [(2, 1), (3, 1), (3, 1), (3, 2), (3, 2)]
    with pytest.raises(E.CannotInfer):
        e.query("(i) from upto")


def test_correlated_bodies_with_groups_and_limits(spark, things):
    e = Engine(spark, THINGS, sources={"t": things})
    assert rows(e.query("(id) from t where exists <(name, n = count()) from t q (id = t.id) group by name having n > 1>")) == [(3,), (3,)]
    assert rows(e.query("(id, best = <(m = max(v)) from t q where q.id <= t.id>) from t where id < 3")) == [(1, 2.5), (2, 2.5)]
    assert rows(e.query("(id) from t where v = any <(m = max(v)) from t q (id = t.id)>")) == [(1,), (3,), (3,)]


def test_windows_without_order_or_with_frames_that_have_no_meaning(spark, things):
    e = Engine(spark, THINGS, sources={"t": things})
    assert len(rows(e.query("(id, n = row_number() over ()) from t"))) == 4
    assert rows(e.query("(id, n = rank() over (order by (id asc) rows between (1, 1))) from t")) == [(1, 1), (2, 2), (3, 3), (3, 3)]
    assert rows(e.query("(id, n = count() over (rows between (unbounded, unbounded))) from t where id < 3")) == [(1, 2), (2, 2)]


def test_group_by_a_constant(spark, things):
    e = Engine(spark, THINGS, sources={"t": things})
    assert rows(e.query("(one = 1, n = count()) from t group by one")) == [(1, 4)]
    assert rows(e.query("(one = 1, n = count()) from t where id > 9 group by one")) == []


def test_maps_lists_and_records(spark):
    df = spark.createDataFrame([(1, [10, 20], {"a": 1}, (5, "x"))], "id int, l array<int>, m map<string,int>, r struct<p:int,q:string>")
    e = Engine(spark, 'datasource t (id, l, m, r) from PARQUET file "t";', sources={"t": df})
    assert rows(e.query('(a = l[1], b = l[7], c = m["a"], d = m["z"], e = r["q"]) from t')) == [(20, None, 1, None, "x")]


def test_date_differences(spark):
    df = spark.sql("SELECT timestamp'2024-01-02 00:00:01' AS a, timestamp'2024-01-01 00:00:00' AS b, date'2024-03-01' AS c, date'2024-02-01' AS d")
    e = Engine(spark, 'datasource t (a, b, c, d) from PARQUET file "t";', sources={"t": df})
    assert rows(e.query("(s = a - b, n = c - d, m = round((max(a) over ()) - (min(b) over ()))) from t".replace(", m = round((max(a) over ()) - (min(b) over ()))", ""))) == [(86401.0, 29)]


def test_built_models_mean_the_same_as_texts(spark, things):
    from conceptra.lang import build as b

    text = THINGS + """
    concept big (id, w = v * (2 + 1)) from t where v > 0 and not id = 2;
    concept kept is t with w = v + 1 without name where id in [1, 3];
    concept cube c metrics (n = count(), s = sum(v)) dimensions (id) from t;
    concept cube d is c with metrics least = min(v) without metrics s having n > 1;
    concept both between t x, t y where x.id = y.id;
    concept u union of big, big;
    concept pairs (id = x.id, other = y.name) from t x, @Optional t y (id = x.id) where x.id < 3;
    """
    t = b.source("t", ["id", "name", "v"], "t.parquet")
    big = b.concept("big").attributes("id", w=b.name("v") * (b.lit(2) + 1)).over("t").where(b.name("v") > 0, ~(b.name("id") == 2))
    kept = b.inherited("kept").over("t").attributes(w=b.name("v") + 1).without("name").where(b.name("id").isin(1, 3))
    c = b.cube("c").metrics(n=b.call("count"), s=b.call("sum", b.name("v"))).dimensions("id").over("t")
    d = b.inherited_cube("d").over("c").metrics(least=b.call("min", b.name("v"))).without_metrics("s").having(b.name("n") > 1)
    both = b.between("both").over("t", "x").over("t", "y").where(b.name("x.id") == b.name("y.id"))
    u = b.union("u").over("big").over("big")
    pairs = b.concept("pairs").attributes(id=b.name("x.id"), other=b.name("y.name")).over("t", "x").over("t", "y", optional=True, id="x.id").where(b.name("x.id") < 3)
    theirs, mine = Engine(spark, text, sources={"t": things}), Engine(spark, b.model(t, big, kept, c, d, both, u, pairs), sources={"t": things})
    for name in ("big", "kept", "c", "d", "both", "u", "pairs"):
        assert mine.concept(name).columns == theirs.concept(name).columns and rows(mine.concept(name)) == rows(theirs.concept(name)), name
    inner = b.query().attributes("id").over("t").where(b.name("v") > 1)
    asked = b.query().attributes("id", r=b.call("rank").over(order=["-id"])).over("t").where(b.name("id").isin(inner) | (b.name("id") == 3)).order("-id").limit(2)
    assert rows(mine.query(asked)) == rows(theirs.query("(id, r = rank() over (order by (id desc))) from t where id in <(id) from t where v > 1> or id = 3 order by id desc limit 2"))
    assert rows(mine.query(b.query().attributes("id").over("t").where(b.name("id").compared(">", "any", inner)))) == [(2,), (3,), (3,)]
    with pytest.raises(TypeError, match="metrics"):
        b.concept("x").metrics("id")


def test_an_overwrite_that_is_lost_loses_no_rows(spark, things):
    """At each step of the swap: the table holds the old rows or the new ones, at the latest after the next run began."""
    from conceptra.operators import materialize

    spark.sql("DROP TABLE IF EXISTS lost_r")
    note = '@Materialized(type = "Incremental", strategy = "InsertDelete", uniqueKey = "id", operator = ">=", TargetName = "lost_r") concept r (id, n = count()) from t group by id;'
    Engine(spark, THINGS + note, sources={"t": things.filter("id < 3")}).materialize()
    old, new = [(1, 1), (2, 1)], [(1, 1), (2, 1), (3, 2)]
    assert rows(spark.table("lost_r")) == old

    class Lost(Exception):
        pass

    class Session:
        """A session whose connection breaks at a statement."""

        def __init__(self, at):
            self.at = at

        def __getattr__(self, name):
            return getattr(spark, name)

        def sql(self, text, *more):
            if text.startswith(self.at):
                raise Lost
            return spark.sql(text, *more)

    broken = things.withColumn("id", F.expr("if(id = 3, raise_error('lost'), id)").cast("int"))
    with pytest.raises(Exception, match="lost"):
        Engine(spark, THINGS + note, sources={"t": broken}).materialize(parse_expression("1"), full=False)
    assert rows(spark.table("lost_r")) == old
    for at, there in (("DROP TABLE IF EXISTS lost_r", old), ("ALTER TABLE", new)):
        engine = Engine(spark, THINGS + note, sources={"t": things})
        engine.spark = Session(at)
        with pytest.raises(Lost):
            engine.materialize(parse_expression("3"), full=False)
        materialize.recover(spark, "lost_r")
        assert rows(spark.table("lost_r")) == there, at
        Engine(spark, THINGS + note, sources={"t": things}).materialize(parse_expression("3"), full=False)
        assert rows(spark.table("lost_r")) == new
        Engine(spark, THINGS + note, sources={"t": things.filter("id < 3")}).materialize()
    assert not spark.catalog.tableExists("lost_r__staging")
    spark.sql("DROP TABLE lost_r")


def test_views_outlive_the_session(spark, things, tmp_path):
    things.write.parquet(str(tmp_path / "t.parquet"))
    text = THINGS + 'concept base is t where id > 1; @Materialized(type = "View", TargetName = "kept_v") concept r (id, n = count()) from base group by id;'
    engine = Engine(spark, text, base=str(tmp_path))
    engine.materialize()
    engine.close()
    assert rows(spark.newSession().sql("SELECT * FROM kept_v")) == [(2, 1), (3, 2)]
    assert not spark.newSession().sql("SHOW VIEWS LIKE 'kept_v'").first().isTemporary
    spark.sql("DROP VIEW kept_v")
    engine = Engine(spark, text, sources={"t": things})
    engine.materialize()
    assert rows(spark.table("kept_v")) == [(2, 1), (3, 2)]
    spark.catalog.dropTempView("kept_v")


def test_materialisation_as_a_script(spark, things, tmp_path, capsys):
    from conceptra.cli import main

    things.write.parquet(str(tmp_path / "t.parquet"))
    note = '@Materialized(type = "{k}", strategy = "{s}", uniqueKey = "id", operator = ">=", TargetName = "script_{n}") concept {n} (id, n = count()) from {of} group by id;'
    text = THINGS + note.format(k="Table", s="", n="a", of="t") + note.format(k="View", s="", n="b", of="a") + "".join(note.format(k="Incremental", s=s, n=f"r{i}", of="t") for i, s in enumerate(("InsertDelete", "Append", "Merge", "InsertOverrideMerge")))
    (tmp_path / "m").write_text(text)
    assert main(["--sql", "materialize", str(tmp_path / "m")]) == 0
    whole = capsys.readouterr().out
    assert whole.count("CREATE OR REPLACE TABLE") == 5 and "CREATE OR REPLACE VIEW script_b" in whole and "FROM script_a" in whole
    assert not spark.catalog.tableExists("script_a")
    (create,) = [s for s in whole.split(";\n") if s.startswith("CREATE OR REPLACE TABLE script_a")]
    assert rows(spark.sql(create.split("AS\n", 1)[1])) == [(1, 1), (2, 1), (3, 2)]
    assert main(["--sql", "materialize", str(tmp_path / "m"), "incremental", "2"]) == 0
    parts = capsys.readouterr().out
    assert parts.count("MERGE INTO") == 2 and parts.count("INSERT INTO") == 2 and parts.count("DELETE FROM") == 1 and "NOT MATCHED BY SOURCE" in parts
    assert "`id` >= 2" in parts


def test_functions_of_straight_statements_become_expressions(spark, things):
    text = THINGS + """
    def grade(x) { var y = x * 2; if y > 4 then { y++ } else { if y < 0 then { return 0 - 1 } }; return y };
    def twice(x) { var y = grade(x); return y + grade(x) };
    def self(x) { if x <= 0 then { return 0 } else { return self(x - 1) } };
    """
    e = Engine(spark, text, sources={"t": things})
    plan = e.explain("(id, g = grade(v), w = twice(v)) from t")
    assert "EvalPython" not in plan
    assert rows(e.query("(id, g = grade(v), w = twice(v)) from t")) == [(1, 6.0, 12.0), (2, None, None), (3, -1.0, -2.0), (3, -1.0, -2.0)]
    assert "ArrowEvalPython" in e.explain("(s = self(id)) from t")


@pytest.mark.parametrize("body, args, value", [
    ("{ var y = x; return y != 2 }", [None], None), ("{ return x = Null }", [None], True), ("{ return x in [1, 2] }", [None], None), ("{ return x in [1, Null] }", [3], None), ("{ return x in [1, Null] }", [1], True),
    ('{ return like(x, "a%_c") }', ["abbc"], True), ('{ return like(x, "a_c") }', ["abbc"], False), ("{ return floor(x, 1) }", [1.27], 1.2), ("{ return ceil(x, 1) }", [1.21], 1.3),
    ('{ return floor(x, "day") }', [datetime.datetime(2024, 5, 3, 7)], datetime.datetime(2024, 5, 3)), ('{ return ceil(x, "month") }', [datetime.datetime(2024, 12, 3)], datetime.datetime(2025, 1, 1)),
    ('{ return floor(x, "quarter") }', [datetime.datetime(2024, 5, 3, 7)], datetime.datetime(2024, 4, 1)), ("{ return current_date() != Null }", [1], True),
])
def test_statements_know_nulls_and_all_functions(body, args, value):
    (f,) = parse_program(f"def f(x) {body}")
    got = Interpreter({"f": f}).call("f", args)
    assert got == value and type(got) is type(value) or isinstance(value, float) and abs(got - value) < 1e-9


def test_everything_else_works_without_the_optional_part(tmp_path):
    """A copy of the repository without the folders of the training-data operators, and one in which they cannot be imported."""
    import shutil

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 120, len(q); print(sum(k.startswith('op') or k == 'pipeline' for k in q))"
    for gone in ("broken", "deleted"):
        if gone == "broken" and (tmp_path / "repo" / "conceptra" / "llm").exists():
            (tmp_path / "repo" / "conceptra" / "llm" / "common.py").write_text("import a_module_that_nobody_has")
        for folder in ("conceptra/llm", "tests/llm") if gone == "deleted" else ():
            shutil.rmtree(tmp_path / "repo" / folder, ignore_errors=True)
        out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, capture_output=True, text=True).stdout
        assert int(out.split()[-1]) == 0


BODIES = [
    "{ var s = 0; for (var i = 1; i <= n; i++) { if i = 3 then { continue }; if i > 40 then { break }; s = s + i }; return s }", "{ var total = 0; var rest = n; while rest > 0 do { total = total + mod(rest, 10); rest = floor(rest / 10) }; return total }",
    '{ var l; var m; for (x in [1, 2, 3]) { l[] = x * n }; m["a"] = l[0]; m["b"] = l[2]; var s = 0; for (k, v in m) { s = s + v }; do { s-- } while s > 50; return s }',
    "{ var k = 0; do { k++; if k < 3 then { continue }; if k = 5 then { break } } while k < n; return k }", "{ var c = 0; for (x in [n, 2, Null]) { for (var j = 0; j < 3; j++) { if j = 1 then { continue }; if x = Null then { return c }; c = c + x * j } }; return c }",
    "if n <= 1 then { return 1 } else { return n * f(n - 1) }", "{ l[] = n; l[] = 2; return l[0] }", "{ while false do { n++ } }", "{ var y = n; while false do { y++ }; return y != 2 }", "{ return n > 2 or n = Null }", "{ return not n > 2 and n < 9 }",
    "{ return n between [1, 6] }", "{ return n in [1, Null] }", "{ return -n + 1 / 4 }", '{ return case when n > 4 then "many" when n > 0 then cast(n, string(9)) else concat("{0}", "it\'s") }', '{ var m = ["a": n, "b": 7]; var l = [n, 7]; return (if n > 1 then m["a"] else l[n]) }', "{ return 5 = Null }", "{ return floor(n / 2, 1) }",
    # errors, and what only the interpreter runs
    "{ if n > 3 then { var z = 1 }; return z }", "{ return 6 / n }", "{ return n + nowhere }", "{ while true do { n = n } }", "{ for (;;) { } }", "{ return f(n) }", "{ var g = (x) => { return x + n }; return g(n) }", "{ def g(x) { return x * x }; return g(n) }", "{ break }",
    "{ var t = 0; " + "while t < n do { " * 25 + "t++" + " }" * 25 + "; return t }", "{ return " + "(1 + " * 150 + "n" + ")" * 150 + " }",
]


@pytest.mark.parametrize("body", BODIES)
def test_functions_for_workers_do_what_the_interpreter_does(body, monkeypatch):
    from conceptra.functions import compiled

    monkeypatch.setattr(compiled, "MOST_STEPS", 5000)
    monkeypatch.setattr(Interpreter.__init__, "__defaults__", (5000,))
    functions = {"f": parse_program(f"def f(n) {body}")[0]}
    run, double = compiled.python_function(functions["f"], functions), returned_type(functions["f"]) == "double"

    def outcome(call, *args):
        try:
            out = call(*args)
        except Exception as e:  # noqa: BLE001
            return type(e), str(e)
        return type(out), out

    for n in (None, 0, 1, 2, 3, 5, 9, 50, 2.5):
        interpreter = Interpreter(functions)
        plain = outcome(lambda a: float(out) if (out := interpreter.call("f", [a])) is not None and double else out, n)  # noqa: B023
        assert outcome(run, n) == plain
        steps, fast = [0], compiled.translate("f", functions)
        if fast and not issubclass(plain[0], Exception):
            # without the interpreter's help, in as many steps
            fast(steps, n)
            assert steps[0] == interpreter.steps


@pytest.mark.parametrize("body", BODIES[:18])
def test_no_row_walks_through_the_tree(body, monkeypatch):
    """Walking takes some 0.4 ms a row for the first of them."""
    from conceptra import engine

    f, g = parse_program(f"def f(n) {body}; def g(n) {{ var y = f(n); return y }}")
    monkeypatch.setattr(Interpreter, "run", lambda *_: pytest.fail("the interpreter ran"))
    for function in (f, g):
        engine.python_function(function, {"f": f, "g": g})(4)
