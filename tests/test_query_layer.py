import pytest

from tarnflow.functions.types import FieldType, json_schema, parse_fields, parse_type, schema_hash
from tarnflow.plans.ask import compile_question, parse_reply
from tarnflow.plans.grammar import QueryError, parse_query
from tarnflow.plans.planner import envelope, run_query
from tarnflow.surfaces import Source, call_tool, handle, openapi

SCHEMA = {n: parse_type(t) for n, t in {"text": "str", "author": "str", "points": "int | null", "tags": "list[str]", "when": "datetime | null", "featured": "bool", "rate": "float | null"}.items()}
ROWS = [
    ("a slow river", "Ida Berg", 12, ["water", "calm"], "2024-03-01", True, 1.5),
    ("two stones", "Olu Ade", None, ["rock"], "2023-01-05", False, float("nan")),
    ("A third thing", "Ida Berg", 40, ["calm", "Rock"], None, False, None),
    ("last_100%", "kim", 7, ["end"], "2024-12-31", True, 9.0),
]
ORDER = "ix"


@pytest.fixture(scope="module")
def items(spark):
    kinds = "ix int, text string, author string, points long, tags array<string>, when string, featured boolean, rate double"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], kinds)


def ask(items, **params):
    return [r["text"] for r in run_query(items, params, SCHEMA, [ORDER]).select("text").collect()] if "fields" not in params else run_query(items, params, SCHEMA, [ORDER]).collect()


@pytest.mark.parametrize(
    "params, rows",
    [
        ({"author": "Ida Berg"}, [0, 2]),
        ({"author": "ida berg"}, []),
        ({"author__ne": "kim"}, [0, 1, 2]),
        ({"points__ne": "7"}, [0, 2]),  # null is not unequal
        ({"points__gt": "7"}, [0, 2]),
        ({"points__gte": "7"}, [0, 2, 3]),
        ({"points__lt": "12 points"}, [3]),
        ({"points__lte": "12"}, [0, 3]),
        ({"points__in": "7,40"}, [2, 3]),
        ({"points__isnull": "true"}, [1]),
        ({"points__isnull": "0"}, [0, 2, 3]),
        ({"text__contains": "A T"}, [2]),
        ({"text__contains": "_100%"}, [3]),
        ({"tags__contains": "calm"}, [0, 2]),
        ({"tags__contains": "cal"}, []),
        ({"tags": "calm"}, []),
        ({"tags__ne": "calm"}, [0, 1, 2, 3]),
        ({"featured": "yes"}, [0, 3]),
        ({"when__gte": "2024-01-01"}, [0, 3]),
        ({"when__lt": "Mar 1, 2024"}, [1]),
        ({"rate__gt": "1"}, [0, 3]),  # NaN is not greater
        ({"q": "ROCK"}, [1, 2]),
        ({"q": ""}, [0, 1, 2, 3]),
        ({"author": "Ida Berg", "points__gt": "20"}, [2]),
    ],
)
def test_filters(items, params, rows):
    assert sorted(ask(items, **params)) == sorted(ROWS[i][0] for i in rows)


@pytest.mark.parametrize(
    "params, rows",
    [
        ({"sort": "points"}, [3, 0, 2, 1]),
        ({"sort": "-points"}, [2, 0, 3, 1]),
        ({"sort": "author,-points"}, [2, 0, 3, 1]),
        ({"sort": "-author"}, [1, 3, 0, 2]),  # equal ones keep their order
        ({"sort": "-when"}, [3, 0, 1, 2]),
        ({"sort": "tags"}, [2, 3, 1, 0]),
        ({"sort": "points", "offset": "1", "limit": "2"}, [0, 2]),
        ({"limit": "0"}, []),
    ],
)
def test_order_and_paging(items, params, rows):
    assert ask(items, **params) == [ROWS[i][0] for i in rows]


def test_projection(items):
    got = ask(items, fields="points,text,points", sort="when", limit="1")
    assert got[0].asDict() == {"points": None, "text": "two stones"}


@pytest.mark.parametrize(
    "params, code",
    [
        ({"points__gt": "abc"}, "invalid_value"),
        ({"points__near": "1"}, "unknown_operator"),
        ({"none__gt": "1"}, "unknown_field"),
        ({"none": "1"}, "unknown_parameter"),
        ({"author__gt": "x"}, "operator_not_supported_for_type"),
        ({"featured__contains": "x"}, "operator_not_supported_for_type"),
        ({"limit": "1001"}, "invalid_control"),
        ({"offset": "-1"}, "invalid_control"),
        ({"sort": "none"}, "invalid_control"),
        ({"points__isnull": "maybe"}, "invalid_value"),
        ({"author": " "}, "invalid_value"),
    ],
)
def test_errors(params, code):
    with pytest.raises(QueryError) as e:
        parse_query(params, SCHEMA)
    assert e.value.as_dict()["code"] == code and e.value.param in params


def test_lookup_parameter_shadows_field():
    query, arguments = parse_query({"author": "x", "author__eq": "y"}, SCHEMA, {"author"})
    assert arguments == {"author": "x"} and query.echo() == {"author": "y"}


def test_envelope_and_surfaces(spark, items):
    query, _ = parse_query({"points__gt": "1", "sort": "-points", "limit": "2", "fields": "points"}, SCHEMA)
    out = envelope({"source": "s"}, items, query, SCHEMA, [ORDER])
    assert out == {"source": "s", "count": 3, "returned": 2, "items": [{"points": 40}, {"points": 12}], "_query": {"points__gt": 1, "sort": "-points", "fields": "points", "limit": 2}}
    sources = {"s": Source("s", SCHEMA, lambda _: items, [ORDER])}
    assert handle(spark, sources, "/v1/s?points__gt=abc")[0] == 400
    assert handle(spark, sources, "/v1/none")[0] == 404
    assert handle(spark, sources, "/v1/s?author=kim&fields=points")[1]["items"] == [{"points": 7}]
    assert call_tool(spark, sources, "get_data", {"source": "s", "filter": {"author": "kim"}, "fields": "points"})["count"] == 1
    assert handle(spark, sources, "/v1/s/ask?q=who", lambda p: "QUERY: author=kim")[1]["count"] == 1
    assert "/v1/s" in openapi(sources)["paths"]


def test_pages_of_an_envelope(spark, items):
    query, _ = parse_query({"fields": "points"}, SCHEMA)
    n, seen = items.count(), []
    while True:
        query.offset = len(seen)
        out = envelope({}, items, query, SCHEMA, [ORDER], most=2)
        seen += out["items"]
        assert out["count"] == n and out["returned"] == len(out["items"]) <= 2
        if "next_offset" not in out:
            break
        assert out["next_offset"] == len(seen)
    assert len(seen) == n and [r["points"] for r in seen] == [r["points"] for r in items.orderBy(ORDER).collect()]
    query.offset = n + 5
    assert envelope({}, items, query, SCHEMA, [ORDER])["count"] == n
    none, _ = parse_query({"fields": ""}, SCHEMA)
    assert envelope({}, items, none, SCHEMA, [ORDER])["items"] == [{}] * n


@pytest.mark.parametrize("reply", ["QUERY:\nauthor=kim\npoints__gt=3", "QUERY: author=kim; points__gt=3", "QUERY: author=kim&points__gt=3", "well\nQUERY:\n- `author`='kim'\n* points__gt=3\nThat is all."])
def test_reply(reply):
    assert parse_reply(reply) == {"author": "kim", "points__gt": "3"}


def test_question_is_repaired():
    prompts = []
    replies = iter(["QUERY: points__near=3", "no idea", "QUERY: points__gt=3"])
    got = compile_question(lambda p: (prompts.append(p), next(replies))[1], "many points?", SCHEMA)
    assert got.rounds == 3 and got.query.echo() == {"points__gt": 3} and "unknown_operator" in prompts[1]


def test_types():
    assert parse_type("enum[a, b] | null") == FieldType("enum", True, members=("a", "b"))
    assert parse_fields("points: int | null the upvotes, kind: enum[a,b] a kind")["points"] == (FieldType("int", True), "the upvotes")
    for bad in ("number", "int | str", "null"):
        with pytest.raises(ValueError):
            parse_type(bad)
    schema = json_schema("s", SCHEMA, "1.0.0")
    assert schema["required"] == ["text", "author", "tags", "featured"] and len(schema_hash(schema)) == 16
