"""Graph queries, routines, dialects and cursors on small tables."""

import random

import pytest

from basalt.plans.cypher import CypherError, parse
from basalt.plans.dialect import Database, translate
from basalt.plans.graph import Graph
from basalt.plans.routines import RoutineError, Routines


def values(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def cities(spark):
    g = Graph(spark)
    g.cypher("CREATE (a:City {name: 'Tokyo'})-[:CONNECTS]->(b:City {name: 'Nagoya'})-[:CONNECTS]->(c:City {name: 'Kyoto'})-[:CONNECTS]->(d:City {name: 'Osaka'})")
    return g


def test_paths(cities):
    assert values(cities.cypher("MATCH (a:City {name: 'Tokyo'})-[:CONNECTS*2..3]->(b) RETURN b.name AS n")) == [("Kyoto",), ("Osaka",)]
    found = cities.cypher("MATCH p = shortestPath((a:City {name: 'Tokyo'})-[*]->(b:City {name: 'Osaka'})) RETURN length(p) AS n")
    assert values(found) == [(3,)]
    found = cities.cypher("MATCH p = (a:City {name: 'Tokyo'})-[:CONNECTS]->(b) RETURN length(p) AS n, b.name AS b")
    assert values(found) == [(1, "Nagoya")]


def test_shortest_paths_to_many_goals(spark):
    """Every start, itself a goal or not, finds the nearest other goal: against a search from each start."""
    rng = random.Random(8)
    n = 24
    links = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(30)})
    goals = {k for k in range(n) if k % 5 == 0}
    nodes = spark.createDataFrame([(k, ["Goal", "Node"] if k in goals else ["Node"], k) for k in range(n)], "id long, labels array<string>, key long")
    edges = spark.createDataFrame([(100 + i, a, b, "LINK") for i, (a, b) in enumerate(links)], "id long, src_id long, dst_id long, type string")
    g = Graph(spark, nodes, edges, "g")
    want = {}
    for s in range(n):
        hops, frontier, d = {s: 0}, {s}, 0
        while frontier and s not in want:
            d += 1
            frontier = {y for a, b in links for x, y in ((a, b), (b, a)) if x in frontier} - set(hops)
            hops |= dict.fromkeys(frontier, d)
            if found := frontier & goals:
                want[s] = (d, min(found))
    rows = g.cypher("MATCH p = shortestPath((a:Node)-[*]-(b:Goal)) RETURN a.key AS a, length(p) AS n, b.key AS b, nodes(p) AS ns").collect()
    assert {r["a"]: (r["n"], r["b"]) for r in rows} == want and len(rows) == len(want)
    for r in rows:
        walk = [x["id"] for x in r["ns"]]
        assert walk[0] == r["a"] and walk[-1] == r["b"] and all(tuple(sorted(p)) in set(links) for p in zip(walk, walk[1:], strict=False))


def test_updates(cities):
    cities.cypher("MATCH (a:City) WHERE a.name = 'Kyoto' SET a.old = true, a:Capital")
    assert values(cities.cypher("MATCH (a:Capital) RETURN a.name AS n, a.old AS o")) == [("Kyoto", True)]
    with pytest.raises(CypherError):
        cities.cypher("MATCH (a:City {name: 'Kyoto'}) DELETE a")
    cities.cypher("MATCH (a:City {name: 'Kyoto'}) DETACH DELETE a")
    assert values(cities.cypher("MATCH (a:City)-[r]->(b) RETURN a.name AS a, b.name AS b")) == [("Tokyo", "Nagoya")]


def test_types_that_differ_give_null(cities):
    assert values(cities.cypher("MATCH (a:City) WHERE a.name > 3 RETURN a.name AS n")) == []


def test_parse_errors():
    with pytest.raises(CypherError):
        parse("MATCH (a RETURN a")


def test_routines(spark):
    r = Routines(spark)
    r.create("CREATE FUNCTION add_one(x int) RETURNS int AS $$ BEGIN RETURN x + 1; END $$ LANGUAGE plpgsql")
    assert spark.sql("SELECT add_one(10) + add_one(20) AS v").first()["v"] == 32
    r.create("""CREATE PROCEDURE p(n int, OUT total int) AS $$ DECLARE i int := 0; BEGIN total := 0;
      <<up>> LOOP i := i + 1; EXIT up WHEN i > n; IF i = 3 THEN CONTINUE; ELSIF i = 4 THEN total := total + 100; ELSE total := total + i; END IF; END LOOP; END $$""")
    assert r.call("p", 5) == {"total": 108}
    assert r.do("DO $$ DECLARE a int := 2; BEGIN WHILE a < 50 LOOP a := a * a; END LOOP; END $$")["a"] == 256
    with pytest.raises(RoutineError):
        r.do("DO $$ BEGIN RAISE EXCEPTION 'stop %', 3; END $$")
    assert r.do("DO $$ DECLARE n int; BEGIN EXECUTE 'SELECT $1 + 1' INTO n USING 41; END $$")["n"] == 42
    assert r.catalog().count() == 2


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.execute("CREATE TABLE accounts (id SERIAL PRIMARY KEY, email VARCHAR(100) UNIQUE, n INT)")
    assert values(db.execute("INSERT INTO accounts (email, n) VALUES ('a@x', 1), ('b@x', 2) RETURNING id, email")) == [(1, "a@x"), (2, "b@x")]
    db.execute("UPDATE accounts SET n = n + 10 WHERE id = 2")
    assert values(db.execute("SELECT id, n FROM accounts")) == [(1, 1), (2, 12)]
    db.execute("DECLARE c SCROLL CURSOR FOR SELECT id FROM accounts ORDER BY id")
    assert values(db.execute("FETCH LAST FROM c")) == [(2,)]
    assert values(db.execute("FETCH PRIOR FROM c")) == [(1,)]
    db.execute("CLOSE ALL")
    db.execute("CREATE LAKE TABLE logs (id BIGINT, day VARCHAR(10)) PARTITIONED BY (day)")
    db.execute("INSERT INTO logs VALUES (1, 'mon'), (2, 'tue')")
    db.execute("DELETE FROM logs WHERE id = 1")
    assert values(db.execute("SELECT id FROM logs")) == [(2,)]
    assert db.execute("SELECT * FROM lake_scan('logs', 1)").count() == 2
    db.read_only = True
    with pytest.raises(PermissionError):
        db.execute("TRUNCATE accounts")


@pytest.mark.parametrize(
    ("mode", "text", "want"),
    [
        ("MSSQLSERVER", "SELECT [a b], '[x]' FROM t", "SELECT `a b`, '[x]' FROM t"),
        ("ORACLE", "SELECT SYSDATE FROM dual MINUS SELECT 1", "SELECT current_timestamp() FROM dual EXCEPT SELECT 1"),
        ("MYSQL", "SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("REGULAR", "SELECT a ~* 'x' FROM t", "SELECT rlike(a, concat('(?i)', 'x')) FROM t"),
        ("REGULAR", "SELECT j ->> 'k' FROM t", "SELECT get_json_object(j, '$.k') FROM t"),
    ],
)
def test_translation(mode, text, want):
    assert translate(text, mode) == want
