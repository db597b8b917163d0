"""A model over a Spark session: concepts and queries as lazy DataFrames, and materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udf

from .functions.compiled import python_function
from .functions.procedural import returned_type
from .lang import ast as A
from .lang.build import node
from .lang.errors import NotFound
from .lang.model import Model, Named
from .operators import materialize
from .plans.lower import Lowering, quoted
from .session import reach_workers
from .sources import files


class Engine:
    """``base``: folder of the sources' relative paths. ``sources``: DataFrames that stand in for data sources by name.

    Every concept becomes a temporary view over the views of its parents, so that a query is one
    logical plan from the files up, whatever number of concepts it goes through.
    """

    def __init__(self, spark: SparkSession, model: Model | str, base: str | None = None, sources: dict[str, DataFrame] | None = None, every: bool = False):
        reach_workers(spark)
        self.spark, self.base, self.given = spark, base, dict(sources or {})
        self.model = Model.parse(model) if isinstance(model, str) else model
        self.prefix = f"c{uuid.uuid4().hex[:12]}_"
        self._frames: dict[str, DataFrame] = {}
        self._texts: dict[str, str] = {}
        self._functions: dict[str, str] = {}
        self._tables: dict[str, str] = {}
        self.lowering = Lowering(self._view, self._schema, self._call, self._table_call, every)

    # functions

    def register(self, name: str, function, returns: str = "double") -> None:
        """A Python function or a Spark UDF under a name of the language."""
        own = self.prefix + name
        if hasattr(function, "returnType"):
            self.spark.udf.register(own, function)
        else:
            self.spark.udf.register(own, function, returns)
        self._functions[name] = own
        self.model.declare(name)

    def register_table(self, name: str, udtf) -> None:
        """A Spark table function for concepts given ``by name``."""
        self.spark.udtf.register(self.prefix + name, udtf)
        self._tables[name] = self.prefix + name

    def _call(self, name: str) -> str:
        if name not in self._functions:
            f = self.model.functions.get(name)
            if f is None:
                raise NotFound(f"there is no function {name}")
            # rows come and go in Arrow batches
            self.spark.udf.register(self.prefix + name, udf(python_function(f, self.model.functions), returned_type(f), useArrow=True))
            self._functions[name] = self.prefix + name
        return self._functions[name]

    def _table_call(self, concept: A.FunctionConcept) -> str:
        if concept.function not in self._tables:
            raise NotFound(f"there is no table function {concept.function}")
        return self._tables[concept.function]

    # relations

    def _view(self, name: str) -> str:
        definition = self.model.concept(name)
        if isinstance(definition, A.FunctionConcept):
            return f"{self._table_call(definition)}()"
        self.concept(name)
        return quoted(self.prefix + name)

    def _schema(self, relation):
        if isinstance(relation, Named) and not isinstance(self.model.concept(relation.name), A.FunctionConcept):
            return self.concept(relation.name).schema
        return None

    def concept(self, name: str) -> DataFrame:
        """The rows of a concept; built once."""
        if name not in self._frames:
            definition = self.model.relation(name)
            if isinstance(definition, A.DataSource):
                frame = files.project(self.given[name], definition) if name in self.given else files.read(self.spark, definition, self.base)
            else:
                self._texts[name] = self.lowering.query(definition)
                frame = self.spark.sql(self._texts[name])
            self.use(name, frame)
        return self._frames[name]

    def use(self, name: str, frame: DataFrame) -> None:
        """From now on the concept's rows are those of ``frame``, e.g. what it was materialised as."""
        self._frames[name] = frame
        frame.createOrReplaceTempView(self.prefix + name)

    def query(self, what) -> DataFrame:
        """A query: text of the language without angle brackets, or a built one."""
        return self.spark.sql(self.sql(what))

    def whole_sql(self, what, tables: dict[str, str] | None = None, strict: bool = False) -> str | None:
        """SQL of a concept, or of a resolved query, down to the files; ``tables`` stand for concepts by name.

        None where the text would need something that only this session has; ``strict`` names it anyway.
        """

        class Local(Exception):
            pass

        def view(name: str) -> str:
            if tables and name in tables:
                return tables[name]
            definition = self.model.concept(name)
            if isinstance(definition, A.FunctionConcept):
                return table_call(definition) + "()"
            relation = self.model.relation(name)
            if isinstance(relation, A.DataSource):
                text = None if name in self.given else files.as_sql(self.spark, relation, self.base)
                if text is None and not strict:
                    raise Local
                return f"({text})" if text else quoted(name)
            return f"({lowering.query(relation)})"

        def call(name: str) -> str:
            if not strict:
                raise Local
            return name

        def table_call(concept: A.FunctionConcept) -> str:
            return call(concept.function)

        lowering = Lowering(view, self._schema, call, table_call, self.lowering.every)
        try:
            return lowering.query(self.model.relation(what) if isinstance(what, str) else what)
        except Local:
            return None

    def sql(self, what) -> str:
        return self.lowering.query(self.model.query(what) if isinstance(what, str) else self.model.subquery(node(what), None))

    def explain(self, what, mode: str = "formatted") -> str:
        return self.query(what)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def materialize(self, value: A.Node | None = None, full: bool = True, only: list[str] | None = None) -> list[str]:
        """Writes all concepts marked ``@Materialized`` in order of their dependencies; the tables' names."""
        return materialize.run(self, value, full, only)

    def script(self, value: A.Node | None = None, full: bool = True, only: list[str] | None = None) -> list[str]:
        """The statements that ``materialize`` stands for, as text; nothing is written."""
        return materialize.script(self, value, full, only)

    def close(self) -> None:
        for name in self._frames:
            self.spark.catalog.dropTempView(self.prefix + name)
