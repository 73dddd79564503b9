import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from lineflow.session import local_session

    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_graphs(spark):
    """Graph records from short specs: kinds, edges, labels and optional code, calls, lines."""
    from lineflow import schema
    from lineflow.functions import graph
    from pyspark.sql import functions as F

    def build(*specs):
        rows = []
        for spec in specs:
            kinds = spec["kinds"]
            n = len(kinds)
            lines = spec.get("lines", list(range(1, n + 1)))
            code = spec.get("code", [f"s{i};" for i in range(n)])
            calls = spec.get("calls", [[] for _ in kinds])
            nodes = [(i, lines[i], kinds[i], code[i], 0, False, calls[i], []) for i in range(n)]
            rows.append(
                (spec.get("id", "g"), spec.get("project", ""), spec.get("commit", ""), spec.get("cwe", ""),
                 [f"s{i};" for i in range(max(lines))], nodes, sorted(spec["edges"]), [],
                 kinds.index("ENTRY"), kinds.index("EXIT"), spec["vuln"], {})
            )
        df = spark.createDataFrame(rows, schema.GRAPH_DDL)
        df = df.withColumn("_s", graph.shape_of(F.size("nodes"), F.col("edges"), F.col("entry")))
        return df.withColumns(
            {
                "nodes": graph.settled(graph.nodes_with_shape(F.col("nodes"), F.col("_s"))),
                "back_edges": F.col("_s.back_edges"),
            }
        ).select(*schema.GRAPH_COLUMNS)

    return build


def line(n=3, vuln=None, **more):
    kinds = ["ENTRY"] + ["ASSIGN"] * n + ["EXIT"]
    return {"id": f"line{n}", "kinds": kinds, "edges": [(i, i + 1) for i in range(n + 1)],
            "vuln": [vuln or n], **more}


def diamond(vuln=3, **more):
    return {"id": "diamond", "kinds": ["ENTRY", "BRANCH", "ASSIGN", "CALL", "ASSIGN", "EXIT"],
            "edges": [(0, 1), (1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "vuln": [vuln], **more}


def loop(vuln=3, **more):
    return {"id": "loop", "kinds": ["ENTRY", "LOOP", "ASSIGN", "CALL", "RETURN", "EXIT"],
            "edges": [(0, 1), (1, 2), (2, 3), (3, 1), (1, 4), (4, 5)], "vuln": [vuln], **more}


def tree(vuln=3, **more):
    return {"id": "tree", "kinds": ["ENTRY", "BRANCH", "BRANCH", "ASSIGN", "ASSIGN", "CALL", "ASSIGN", "EXIT"],
            "edges": [(0, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 6), (4, 7), (5, 7), (6, 7)], "vuln": [vuln], **more}


def switch(cases, vuln=2, **more):
    n = cases
    return {"id": f"switch{n}", "kinds": ["ENTRY", "SWITCH"] + ["ASSIGN"] * n + ["RETURN", "EXIT"],
            "edges": [(0, 1)] + [(1, 2 + i) for i in range(n)] + [(2 + i, 2 + n) for i in range(n)] + [(2 + n, 3 + n)],
            "vuln": [vuln], **more}
