"""Property graphs as two tables, and graph queries as joins over them.

Nodes have ``id``, ``labels`` and a column a property; edges ``id``, ``src_id``, ``dst_id``, ``type``
and a column a property, so properties keep their types and scans are pruned.  A row of bindings holds a
struct for each variable.  Clauses run in the order of the text.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from basalt.operators.recursive import round_table
from basalt.plans.cypher import Clause, CypherError, EdgePattern, Expr, NodePattern, PathPattern, Projection, parse

_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_EDGE = "id long, src_id long, dst_id long, type string"


def _and(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


class Graph:
    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None, name: str = "g"):
        self.spark, self.name = spark, name
        self.nodes = nodes if nodes is not None else spark.createDataFrame([], "id long, labels array<string>")
        self.edges = edges if edges is not None else spark.createDataFrame([], _EDGE)
        self.counters: dict[str, int] = {}

    # tables for SQL

    def sql_nodes(self) -> DataFrame:
        props = [c for c in self.nodes.columns if c not in ("id", "labels")]
        return self.nodes.select("id", "labels", (F.to_json(F.struct(*props)) if props else F.lit("{}")).alias("properties"))

    def sql_edges(self) -> DataFrame:
        props = [c for c in self.edges.columns if c not in ("id", "src_id", "dst_id", "type")]
        return self.edges.select("id", "src_id", "dst_id", "type", (F.to_json(F.struct(*props)) if props else F.lit("{}")).alias("properties"))

    def register(self) -> None:
        """graph_<name>_nodes and graph_<name>_edges."""
        self.sql_nodes().createOrReplaceTempView(f"graph_{self.name}_nodes")
        self.sql_edges().createOrReplaceTempView(f"graph_{self.name}_edges")

    # queries

    def cypher(self, text: str, params: dict[str, Any] | None = None, columns: list[str] | None = None) -> DataFrame:
        """Run a query; updates change this graph, RETURN gives a table."""
        query = parse(text)
        run = _Run(self, params or {})
        for clause in query.clauses:
            run.clause(clause)
        if query.returns is None:
            return self.spark.createDataFrame([tuple(run.counters.values())], ", ".join(f"{k} long" for k in run.counters))
        self.counters = run.counters
        out = run.project(query.returns)
        return out.toDF(*columns) if columns else out

    def cypher_for_sql(self, text: str, params: dict[str, Any] | None = None, columns: list[str] | None = None) -> DataFrame:
        """As a table function: nodes, edges and paths become text, lists and maps JSON."""
        out = self.cypher(text, params, columns)
        return out.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (StructType, ArrayType)) else F.col(f"`{f.name}`")).alias(f.name) for f in out.schema])


class _Run:
    def __init__(self, graph: Graph, params: dict[str, Any]):
        self.graph, self.params = graph, params
        self.rows: DataFrame | None = None
        self.kinds: dict[str, str] = {}  # variable -> node, edge, edges, path
        self.hidden = 0
        self.counters = dict.fromkeys(("nodes_created", "relationships_created", "properties_set", "labels_added", "nodes_deleted", "relationships_deleted"), 0)

    def fresh(self, what: str) -> str:
        self.hidden += 1
        return f"_{what}{self.hidden}"

    # expressions

    def value(self, e: Expr) -> Column:
        if e.kind == "literal":
            return F.lit(e.value)
        if e.kind == "param":
            return F.lit(self.params[e.value])
        if e.kind == "list":
            return F.array(*map(self.value, e.args))
        if e.kind == "var":
            if e.value not in self.kinds:
                raise CypherError(f"unknown variable {e.value}")
            return F.col(f"`{e.value}`")
        if e.kind == "prop":
            var, prop = e.value
            if var not in self.kinds:
                raise CypherError(f"unknown variable {var}")
            have = self.rows.schema[var].dataType
            return F.col(f"`{var}`")[prop] if isinstance(have, StructType) and prop in have.names else F.lit(None)
        if e.kind == "unary":
            v = self.value(e.args[0])
            return ~v if e.value == "NOT" else -v
        if e.kind == "binary":
            return self._binary(e.value, e.args)
        return self._call(e.value, e.args)

    def _type(self, c: Column) -> str:
        return (self.rows if self.rows is not None else self.graph.spark.range(1)).select(c.alias("x")).dtypes[0][1]

    def _binary(self, op: str, args: list[Expr]) -> Column:
        a, b = map(self.value, args)
        if op in ("AND", "OR"):
            return a & b if op == "AND" else a | b
        ta, tb = self._type(a), self._type(b)
        if ta != tb and "string" in (ta, tb) and "void" not in (ta, tb):
            if op == "+":
                return F.concat(a.cast("string"), b.cast("string"))
            a, b = (x.try_cast("double") if t == "string" else x for x, t in ((a, ta), (b, tb)))  # types that differ give null
        if op == "+" and ta == tb == "string":
            return F.concat(a, b)
        whole = all(t in ("int", "bigint", "smallint", "tinyint") for t in (ta, tb))
        if op == "/":
            return F.when(b != 0, F.call_function("div", a, b)) if whole else F.try_divide(a, b)
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
                "+": lambda: F.try_add(a, b), "-": lambda: F.try_subtract(a, b), "*": lambda: F.try_multiply(a, b)}[op]()

    def _call(self, name: str, args: list[Expr]) -> Column:
        plain = name.removesuffix(" distinct")
        if plain in _AGGREGATES:
            if args and args[0].kind == "star":
                return F.count("*")
            v = self.value(args[0])
            if name.endswith(" distinct"):
                if plain == "count":
                    return F.count_distinct(v)
                if plain == "collect":
                    return F.array_sort(F.collect_set(v))
                return {"sum": F.sum_distinct, "avg": F.avg, "min": F.min, "max": F.max}[plain](v)
            return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}[plain](v)
        if plain == "timestamp":
            return F.unix_millis(F.current_timestamp())
        first = self.value(args[0])
        kind = self.kinds.get(args[0].value) if args[0].kind == "var" else None
        if plain == "id":
            return first["id"]
        if plain == "labels":
            return first["labels"]
        if plain == "type":
            return first["type"]
        if plain in ("length", "size"):
            return F.size(first["edges"]) if kind == "path" else F.size(first) if kind == "edges" else F.char_length(first)
        if plain in ("nodes", "relationships"):
            return first["nodes" if plain == "nodes" else "edges"]
        if plain == "coalesce":
            return F.coalesce(*map(self.value, args))
        casts = {"tointeger": "long", "tofloat": "double", "tostring": "string", "toboolean": "boolean"}
        if plain in casts:
            inner = first.try_cast("double") if plain == "tointeger" else first
            return inner.try_cast(casts[plain])
        raise CypherError(f"unknown function {name}")

    # matching

    def clause(self, clause: Clause) -> None:
        if clause.kind == "match":
            for p in clause.patterns:
                self.match(p)
            if clause.where is not None:
                self.rows = self.rows.filter(self.value(clause.where))
        elif clause.kind == "optional":
            self.optional(clause)
        elif clause.kind == "create":
            for p in clause.patterns:
                self.create(p)
        elif clause.kind == "merge":
            self.merge(clause)
        elif clause.kind == "set":
            self.assign(clause.items)
        else:
            self.delete(clause.items, clause.kind == "detach")

    def optional(self, clause: Clause) -> None:
        """A left join: rows without a match keep nulls."""
        if self.rows is None:
            self.clause(Clause("match", clause.patterns, clause.where))
            return
        before, known = self.rows, dict(self.kinds)
        tag = self.fresh("row")
        before = round_table(before.withColumn(tag, F.monotonically_increasing_id()))
        self.rows = before
        self.clause(Clause("match", clause.patterns, clause.where))
        new = [v for v in self.kinds if v not in known]
        self.rows = before.join(self.rows.select(tag, *[f"`{v}`" for v in new]), tag, "left").drop(tag)

    def _scan(self, pattern: NodePattern) -> DataFrame:
        """Nodes of a pattern: labels whatever their case, properties pushed down."""
        nodes = self.graph.nodes
        tests = [F.array_contains(F.transform("labels", F.lower), wanted) for wanted in map(str.lower, pattern.labels)]
        return nodes.filter(_and(tests)).filter(self._props(nodes, pattern.properties)) if tests or pattern.properties else nodes

    def _props(self, table: DataFrame, properties: dict[str, Expr]) -> Column:
        tests = []
        for k, e in properties.items():
            if k not in table.columns:
                return F.lit(False)
            tests.append(table[k] == self.value(e))
        return _and(tests)

    def _join(self, right: DataFrame, on: Column | None) -> None:
        self.rows = right if self.rows is None else self.rows.crossJoin(right) if on is None else self.rows.join(right, on)

    def bind_node(self, pattern: NodePattern, var: str) -> None:
        scanned = self._scan(pattern).select(F.struct(*self.graph.nodes.columns).alias(var))
        if var in self.kinds:
            if pattern.labels or pattern.properties:
                other = self.fresh("n")
                self.rows = self.rows.join(scanned.withColumnRenamed(var, other), F.col(f"{var}.id") == F.col(f"{other}.id"), "left_semi")
        else:
            self._join(scanned, None)
            self.kinds[var] = "node"

    def _edges(self, pattern: EdgePattern) -> DataFrame:
        """(e, from, to) in the pattern's direction."""
        edges = self.graph.edges
        if pattern.types:
            edges = edges.filter(F.lower("type").isin([t.lower() for t in pattern.types]))
        edges = edges.filter(self._props(edges, pattern.properties)) if pattern.properties else edges
        e = F.struct(*self.graph.edges.columns).alias("_e")
        out = edges.select(e, F.col("src_id").alias("_from"), F.col("dst_id").alias("_to"))
        back = edges.select(e, F.col("dst_id").alias("_from"), F.col("src_id").alias("_to"))
        if pattern.direction == "both":
            return out.unionByName(back.filter("_from <> _to"))
        return out if pattern.direction == "out" else back

    def match(self, path: PathPattern) -> None:
        first = path.nodes[0].var or self.fresh("n")
        self.bind_node(path.nodes[0], first)
        if path.shortest:
            self._shortest(path, first)
            return
        used = self.fresh("used")
        along = self.fresh("along")
        self.rows = self.rows.withColumn(used, F.array().cast(self._edge_type()))
        self.rows = self.rows.withColumn(along, F.array(F.col(f"`{first}`")))
        at = first
        for edge, node in zip(path.edges, path.nodes[1:], strict=True):
            target = node.var or self.fresh("n")
            if edge.hops:
                self._walk(edge, node, at, target, used, along)
            else:
                e = edge.var or self.fresh("e")
                self._hop(edge, at, e, used)
                self._arrive(node, target, along)
                if edge.var:
                    self.kinds[edge.var] = "edge"
                else:
                    self.rows = self.rows.drop(e)
            at = target
        if path.var:
            self.rows = self.rows.withColumn(path.var, F.struct(F.col(along).alias("nodes"), F.col(used).alias("edges")))
            self.kinds[path.var] = "path"
        self.rows = self.rows.drop(used, along)

    def _hop(self, edge: EdgePattern, at: str, e: str, used: str) -> None:
        """One edge from ``at``; an edge is taken once in a path."""
        edges = self._edges(edge).withColumnRenamed("_e", e)
        rows = self.rows.join(edges, F.col(f"`{at}`.id") == F.col("_from")).drop("_from")
        rows = rows.filter(~F.exists(used, lambda x: x["id"] == F.col(f"`{e}`.id")))
        self.rows = rows.withColumn(used, F.concat(F.col(used), F.array(F.col(f"`{e}`"))))

    def _arrive(self, node: NodePattern, target: str, along: str) -> None:
        """The node at the column ``_to``."""
        if target in self.kinds:
            self.rows = self.rows.filter(F.col("_to") == F.col(f"`{target}`.id"))
            self.bind_node(node, target)
        else:
            self.rows = self.rows.join(self._scan(node).select(F.struct(*self.graph.nodes.columns).alias(target)), F.col("_to") == F.col(f"`{target}`.id"))
            self.kinds[target] = "node"
        self.rows = self.rows.drop("_to").withColumn(along, F.concat(F.col(along), F.array(F.col(f"`{target}`"))))

    def _walk(self, edge: EdgePattern, node: NodePattern, at: str, target: str, used: str, along: str) -> None:
        """Paths of low to high edges: one join a hop, each round a written table."""
        low, high = edge.hops
        start = self.fresh("start")
        base = self.rows.withColumn("_to", F.col(f"`{at}`.id")).withColumn(start, F.size(used))
        frontier, found = base, [base] if low == 0 else []
        edges = self._edges(edge)
        for hop in range(1, high + 1):
            step = frontier.withColumnRenamed("_to", "_at").join(edges, F.col("_at") == F.col("_from")).drop("_at", "_from")
            step = step.filter(~F.exists(used, lambda x: x["id"] == F.col("_e.id"))).withColumn(used, F.concat(F.col(used), F.array(F.col("_e")))).drop("_e")
            frontier = round_table(step)
            if frontier.isEmpty():
                break
            if hop >= low:
                found.append(frontier)
        self.rows = reduce(lambda a, b: a.unionByName(b), found) if found else base.filter(F.lit(False))
        if edge.var:
            n = F.size(used) - F.col(start)
            self.rows = self.rows.withColumn(edge.var, F.slice(F.col(used), F.col(start) + 1, F.greatest(n, F.lit(0))))
            self.kinds[edge.var] = "edges"
        self.rows = self.rows.drop(start)
        self._arrive(node, target, along)

    def _shortest(self, path: PathPattern, first: str) -> None:
        """Breadth-first: for each start the nearest match of the target, the least node among equals."""
        edge, node = path.edges[0], path.nodes[1]
        target = node.var or self.fresh("n")
        goal = self._scan(node).select(F.col("id").alias("_goal"))
        if target in self.kinds:
            goal = self.rows.select(F.col(f"`{target}`.id").alias("_goal")).distinct()
        edges = self._edges(edge)
        starts = self.rows.select(F.col(f"`{first}`.id").alias("_s")).distinct()
        if target in self.kinds:
            pairs = self.rows.select(F.col(f"`{first}`.id").alias("_s"), F.col(f"`{target}`.id").alias("_goal")).distinct()
            results = self._from_starts(starts, pairs, edges)
        else:
            results = self._from_goals(starts, goal, edges)
        on = F.col(f"`{first}`.id") == F.col("_s")
        self.rows = self.rows.join(results, on & (F.col(f"`{target}`.id") == F.col("_goal")) if target in self.kinds else on)
        if target not in self.kinds:
            ends = self._scan(node).select(F.struct(*self.graph.nodes.columns).alias(target))
            self.rows = self.rows.join(ends, F.col("_goal") == F.col(f"`{target}`.id"))
            self.kinds[target] = "node"
        if edge.var:
            self.rows = self.rows.withColumn(edge.var, F.col("_p"))
            self.kinds[edge.var] = "edges"
        if path.var:
            self._path_with_nodes(path.var, first)
        self.rows = self.rows.drop("_s", "_goal", "_p")

    def _edge_type(self) -> str:
        return f"array<struct<{','.join(f'{k}:{t}' for k, t in self.graph.edges.dtypes)}>>"

    def _from_starts(self, starts: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
        """_s, _goal, _p of wanted pairs: from each start of its own."""
        frontier = seen = round_table(starts.select("_s", F.col("_s").alias("_n"), F.array().cast(self._edge_type()).alias("_p")))
        results = frontier.select("_s", F.col("_n").alias("_goal"), "_p").filter(F.lit(False))
        while True:
            step = frontier.join(edges, F.col("_n") == F.col("_from")).select("_s", F.col("_to").alias("_n"), F.concat("_p", F.array("_e")).alias("_p"))
            w = Window.partitionBy("_s", "_n").orderBy(F.transform("_p", lambda x: x["id"]))
            step = step.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
            frontier = round_table(step.join(seen.select("_s", "_n"), ["_s", "_n"], "left_anti"))
            if frontier.isEmpty():
                return results
            seen = seen.select("_s", "_n").unionByName(frontier.select("_s", "_n"))
            hit = frontier.withColumnRenamed("_n", "_goal").join(pairs, ["_s", "_goal"], "left_semi")
            results = results.unionByName(hit.select("_s", "_goal", "_p"))

    def _from_goals(self, starts: DataFrame, goal: DataFrame, edges: DataFrame) -> DataFrame:
        """_s, _goal, _p of the nearest other goal of each start: one search back from all goals, whatever the number of starts.

        A node keeps the two goals nearest to it; a third can be nobody's nearest by way of it, as one of the two isn't where one began.
        """
        frontier = round_table(goal.distinct().select("_goal", F.col("_goal").alias("_n"), F.array().cast(self._edge_type()).alias("_p")))
        seen = frontier.select("_goal", "_n")
        results = frontier.select(F.col("_n").alias("_s"), "_goal", "_p").filter(F.lit(False))
        while not frontier.isEmpty():
            step = frontier.join(edges, F.col("_n") == F.col("_to")).select("_goal", F.col("_from").alias("_n"), F.concat(F.array("_e"), "_p").alias("_p"))
            least = Window.partitionBy("_goal", "_n").orderBy(F.transform("_p", lambda x: x["id"]))
            step = step.withColumn("_r", F.row_number().over(least)).filter("_r = 1").drop("_r").join(seen, ["_goal", "_n"], "left_anti")
            held = seen.groupBy("_n").agg(F.count("*").alias("_held"))
            rank = F.row_number().over(Window.partitionBy("_n").orderBy("_goal")) + F.coalesce("_held", F.lit(0))
            frontier = round_table(step.join(held, "_n", "left").withColumn("_r", rank).filter("_r <= 2").select("_goal", "_n", "_p"))
            seen = seen.unionByName(frontier.select("_goal", "_n"))
            hit = frontier.filter("_goal <> _n").withColumnRenamed("_n", "_s").join(starts, "_s", "left_semi")
            results = results.unionByName(hit.select("_s", "_goal", "_p"))
        first = Window.partitionBy("_s").orderBy(F.size("_p"), "_goal")
        return results.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")

    def _path_with_nodes(self, var: str, first: str) -> None:
        """nodes and edges of the path in ``_p``, its nodes joined by id and put in order."""
        tag = self.fresh("row")
        rows = round_table(self.rows.withColumn(tag, F.monotonically_increasing_id()))
        ids = F.aggregate("_p", F.array(F.col(f"`{first}`.id")), lambda acc, e: F.concat(acc, F.array(F.when(e["src_id"] == F.element_at(acc, -1), e["dst_id"]).otherwise(e["src_id"]))))
        steps = rows.select(tag, F.posexplode(ids).alias("_k", "_id"))
        named = steps.join(self.graph.nodes.select(F.struct(*self.graph.nodes.columns).alias("_node")), F.col("_id") == F.col("_node.id"))
        lists = named.groupBy(tag).agg(F.array_sort(F.collect_list(F.struct("_k", "_node"))).alias("_l"))
        joined = rows.join(lists.select(tag, F.transform("_l", lambda x: x["_node"]).alias("_nodes")), tag)
        self.rows = joined.withColumn(var, F.struct(F.col("_nodes").alias("nodes"), F.col("_p").alias("edges"))).drop(tag, "_nodes")
        self.kinds[var] = "path"

    # updates

    def _one_row(self) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(0).alias("_one"))

    def _add(self, table: str, new: DataFrame) -> None:
        have = getattr(self.graph, table)
        setattr(self.graph, table, round_table(have.unionByName(new, allowMissingColumns=True)))

    def _new_ids(self, table: str, rows: DataFrame, name: str) -> DataFrame:
        from basalt.sources.mutable import number_rows

        most = getattr(self.graph, table).agg(F.max("id")).first()[0] or 0
        return number_rows(rows, name, most + 1, 1)

    def create(self, path: PathPattern) -> None:
        rows = self.rows if self.rows is not None else self._one_row()
        self.rows = rows
        names = []
        for node in path.nodes:
            var = node.var or self.fresh("n")
            names.append(var)
            if var in self.kinds:
                continue
            made = round_table(self._new_ids("nodes", self.rows, "_id"))
            props = {k: self.value(e) for k, e in node.properties.items()}
            fields = [F.col("_id").cast("long").alias("id"), F.array(*map(F.lit, node.labels)).cast("array<string>").alias("labels"), *[v.alias(k) for k, v in props.items()]]
            self._add("nodes", made.select(*fields))
            whole = self.graph.nodes.select(F.struct(*self.graph.nodes.columns).alias(var))
            self.rows = made.join(whole, F.col("_id") == F.col(f"`{var}`.id")).drop("_id")
            self.kinds[var] = "node"
            n = made.count()
            self.counters["nodes_created"] += n
            self.counters["properties_set"] += n * len(props)
            self.counters["labels_added"] += n * len(node.labels)
        for k, edge in enumerate(path.edges):
            a, b = (names[k], names[k + 1]) if edge.direction != "in" else (names[k + 1], names[k])
            if len(edge.types) != 1:
                raise CypherError("an edge to create needs one type")
            made = round_table(self._new_ids("edges", self.rows, "_id"))
            props = {p: self.value(e) for p, e in edge.properties.items()}
            fields = [F.col("_id").cast("long").alias("id"), F.col(f"`{a}`.id").alias("src_id"), F.col(f"`{b}`.id").alias("dst_id"), F.lit(edge.types[0]).alias("type")]
            self._add("edges", made.select(*fields, *[v.alias(p) for p, v in props.items()]))
            self.rows = made
            if edge.var:
                whole = self.graph.edges.select(F.struct(*self.graph.edges.columns).alias(edge.var))
                self.rows = made.join(whole, F.col("_id") == F.col(f"`{edge.var}`.id"))
                self.kinds[edge.var] = "edge"
            self.rows = self.rows.drop("_id")
            n = made.count()
            self.counters["relationships_created"] += n
            self.counters["properties_set"] += n * len(props)

    def merge(self, clause: Clause) -> None:
        """Match, or create what isn't there."""
        path = clause.patterns[0]
        before, known = self.rows, dict(self.kinds)
        self.match(path)
        if before is None:
            if self.rows.isEmpty():
                self.rows, self.kinds = None, {}
                self.create(path)
                self.assign(clause.on_create)
            else:
                self.rows = round_table(self.rows.limit(1))
                self.assign(clause.on_match)
            return
        bound = [v for v, k in known.items() if k == "node"]
        keys = [F.col(f"`{v}`.id") for v in bound]
        matched = round_table(self.rows)
        hit = matched.select(*[c.alias(f"_k{i}") for i, c in enumerate(keys)]).distinct()
        on = _and([F.col(f"`{v}`.id") == F.col(f"_k{i}") for i, v in enumerate(bound)])
        missing = round_table(before.join(hit, on, "left_anti"))
        found_kinds = dict(self.kinds)
        self.rows, self.kinds = missing, known
        if not missing.isEmpty():
            self.create(path)
            self.assign(clause.on_create)
        created = self.rows
        self.rows, self.kinds = matched, found_kinds
        if not matched.isEmpty():
            self.assign(clause.on_match)
        if not missing.isEmpty():
            shared = [c for c in self.rows.columns if c in created.columns]
            self._refresh()
            self.rows = self.rows.select(*[f"`{c}`" for c in shared])
            matched_rows = self.rows
            self.rows = created
            self._refresh()
            self.rows = matched_rows.unionByName(self.rows.select(*[f"`{c}`" for c in shared]), allowMissingColumns=True)

    def _refresh(self) -> None:
        """Bindings of nodes and edges as they are now."""
        for var, kind in self.kinds.items():
            if kind in ("node", "edge") and self.rows is not None and var in self.rows.columns:
                table = self.graph.nodes if kind == "node" else self.graph.edges
                whole = table.select(F.struct(*table.columns).alias("_now"))
                self.rows = self.rows.join(whole, F.col(f"`{var}`.id") == F.col("_now.id"), "left").withColumn(var, F.col("_now")).drop("_now")

    def assign(self, items: list) -> None:
        for var, prop, what in items:
            table = "nodes" if self.kinds[var] == "node" else "edges"
            have = getattr(self.graph, table)
            if prop is None:
                ids = self.rows.select(F.col(f"`{var}`.id").alias("id")).distinct().withColumn("_set", F.lit(True))
                joined = have.join(ids, "id", "left")
                labels = F.when(F.col("_set"), F.array_union("labels", F.array(F.lit(what)))).otherwise(F.col("labels"))
                new = joined.withColumn("labels", labels).drop("_set")
                self.counters["labels_added"] += ids.count()
            else:
                values = self.rows.select(F.col(f"`{var}`.id").alias("id"), self.value(what).alias("_v")).groupBy("id").agg(F.max("_v").alias("_v")).withColumn("_set", F.lit(True))
                joined = have.join(values, "id", "left")
                old = F.col(f"`{prop}`") if prop in have.columns else F.lit(None)
                new = joined.withColumn(prop, F.when(F.col("_set"), F.col("_v")).otherwise(old)).drop("_v", "_set")
                self.counters["properties_set"] += values.count()
            setattr(self.graph, table, round_table(new.select(*have.columns, *([prop] if prop and prop not in have.columns else []))))
        if items:
            self._refresh()

    def delete(self, names: list[str], detach: bool) -> None:
        for var in names:
            ids = round_table(self.rows.filter(F.col(f"`{var}`").isNotNull()).select(F.col(f"`{var}`.id").alias("id")).distinct())
            if self.kinds[var] == "edge":
                self.counters["relationships_deleted"] += ids.count()
                self.graph.edges = round_table(self.graph.edges.join(ids, "id", "left_anti"))
                continue
            src, dst = ids.withColumnRenamed("id", "src_id"), ids.withColumnRenamed("id", "dst_id")
            left = round_table(self.graph.edges.join(src, "src_id", "left_anti").join(dst, "dst_id", "left_anti").select(self.graph.edges.columns))
            attached = self.graph.edges.count() - left.count()
            if attached and not detach:
                raise CypherError("nodes to delete still have edges")
            self.graph.edges = left
            self.counters["relationships_deleted"] += attached
            self.counters["nodes_deleted"] += ids.count()
            self.graph.nodes = round_table(self.graph.nodes.join(ids, "id", "left_anti"))

    # projection

    def _aggregates(self, e: Expr) -> bool:
        return (e.kind == "call" and e.value.removesuffix(" distinct") in _AGGREGATES) or any(isinstance(a, Expr) and self._aggregates(a) for a in e.args)

    def project(self, p: Projection) -> DataFrame:
        if self.rows is None:
            self.rows = self._one_row()
        names = [n for _, n in p.items]
        if any(self._aggregates(e) for e, _ in p.items):
            keys = [self.value(e).alias(n) for e, n in p.items if not self._aggregates(e)]
            out = self.rows.groupBy(*keys).agg(*[self.value(e).alias(n) for e, n in p.items if self._aggregates(e)])
            out = out.select(*[f"`{n}`" for n in names])
        else:
            extra = {}
            for k, (e, _) in enumerate(p.order):  # a key that isn't returned is kept until the sort
                if self._output(e, p) is None and not p.distinct:
                    extra[f"_o{k}"] = self.value(e)
            out = self.rows.select(*[self.value(e).alias(n) for e, n in p.items], *[v.alias(k) for k, v in extra.items()])
        if p.distinct:
            out = out.distinct()
        if p.order:
            keys = []
            for k, (e, down) in enumerate(p.order):
                name = self._output(e, p) or f"_o{k}"
                if name not in out.columns:
                    raise CypherError("a sort key must be returned here")
                keys.append(F.desc(f"`{name}`") if down else F.asc(f"`{name}`"))
            out = out.orderBy(*keys)
        if p.skip is not None:
            out = out.offset(self._number(p.skip))
        if p.limit is not None:
            out = out.limit(self._number(p.limit))
        return out.select(*[f"`{n}`" for n in names])

    def _output(self, e: Expr, p: Projection) -> str | None:
        for own, name in p.items:
            if own == e or (e.kind == "var" and e.value == name):
                return name
        return None

    def _number(self, e: Expr) -> int:
        return int(self.params[e.value] if e.kind == "param" else e.value)
