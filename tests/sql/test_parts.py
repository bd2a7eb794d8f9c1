import hashlib
import hmac

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.sql import encode, lexer, pseudonyms, rewrite, routing, to_char


def test_routing_values():
    same = {"10.0": "10", "-0.0": "0", "1.50": "1.5", "1.5e3": "1500", "15e-1": "1.5", "-0e5": "0", "1e20": "1" + "0" * 20, "'2'": "2", "'10.0'": "10", "-1e2": "-100"}
    for text, want in same.items():
        assert routing.routing_value(text) == want
    for text in ("inf", "nan", "1e", "e5", "1.2.3e4", "'abc'", "'a''b'", "true"):
        assert routing.routing_value(text) == text
    assert routing.shard_of("10.0", 7) == xxhash.xxh3_64_intdigest(b"10") % 7


@given(st.integers(-(10**18), 10**18), st.integers(0, 6))
@settings(deadline=None)
def test_every_spelling_of_a_number_routes_alike(n, zeros):
    assert {routing.routing_value(x) for x in (str(n), f"{n}." + "0" * zeros, f"'{n}'", f"{n}e0", f"{n * 10**zeros}e-{zeros}")} == {str(n)}


def test_key_literals():
    def key(where):
        return routing.key_literal(lexer.tokens(where), "id")

    assert key("id = 5") == "5" and key("5 = id AND v > 1") == "5" and key("(id = 'x') AND v = 2") == "'x'" and key("t.id = -3") == "-3"
    assert key("id = 5 OR v = 1") is None and key("id > 5") is None and key("v = 5") is None and key("id = v") is None
    assert key("v BETWEEN 1 AND 2 AND id = 7") == "7"


def test_strings_and_comments_are_opaque():
    found = lexer.statements("SELECT ';--x' -- ; no\n; SELECT /* ; */ $$a;b$$, E'\\n', \"q;\"")
    assert len(found) == 2
    assert [t.string for t in found[1] if t.kind == "string"] == ["a;b", "\n"]


def test_null_places_are_stated():
    text = rewrite.spark_sql(lexer.tokens("SELECT row_number() OVER (ORDER BY a DESC) FROM t ORDER BY b, c DESC NULLS LAST LIMIT 3"))
    assert "a DESC NULLS FIRST" in text and "b NULLS LAST" in text and "c DESC NULLS LAST" in text and text.endswith("LIMIT 3")


def test_relations():
    names = rewrite.relations(lexer.tokens("WITH x AS (SELECT * FROM a.b) SELECT extract(year FROM ts) FROM x, c JOIN d ON true WHERE e IN (SELECT f FROM g)"))
    assert ("a", "b") in names and {n for _, n in names} >= {"b", "x", "c", "d", "g"}


def test_templates():
    assert to_char.java_pattern("YYYY-MM-DD HH24:MI:SS") == "yyyy-MM-dd HH:mm:ss"
    assert to_char.java_pattern("FMMonth of YY") == "MMMM' of 'yy"


@given(st.binary(min_size=1, max_size=100), st.text())
@settings(deadline=None)
def test_digest(key, value):
    text = key.decode("latin-1")
    value = value.encode("utf-8", "ignore").decode()
    assert pseudonyms.digest(text, value) == hmac.new(text.encode(), value.encode(), hashlib.sha256).hexdigest()


def test_text_forms():
    assert [encode.text(v) for v in (None, True, float("inf"), float("nan"), [1, None], b"\x01", 1.5)] == [None, "true", "inf", "NaN", "{1,NULL}", "\\x01", "1.5"]
