import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwright.llm import chat


def test_driver_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = sorted(con.execute(chat.OP4_SQL).fetchall())
    got = sorted(tuple(r) for r in chat.op4_chat_formatting(spark, sf).collect())
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b\\", "###", ""]), st.text(alphabet="\\#</turn>: \nabü"))))
def test_round_trip(turns):
    text, loss = chat.Template().render(messages=[{"role": r, "text": t} for r, t in turns])
    assert list(chat.read_turns(text)) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in loss) == "".join(t for r, t in turns if r == "assistant")


def test_language():
    r = lambda s, **v: chat.Template(s).render(**v)[0]
    assert r("{% set x = 2 %}{{ x + 3 * 4 }}{# note #}") == "14"
    assert r("{% for i in xs %}{{ loop.index }}{{ ',' if not loop.last }}{% endfor %}", xs=[5, 6]) == "1,2"
    assert r("{% if a and not b %}x{% elif b == 'q' %}y{% else %}z{% endif %}", a=1, b="q") == "y"
    assert r("{{ m['k']|upper ~ m.missing }}", m={"k": "v"}) == "V"
    for bad in ("{% for x %}", "{{ x() }}", "{% if x %}", "{{ x|nope }}", "{% nope %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        r("{{ x.__class__ }}", x=object())
    assert r("{{ x.__class__ }}", x={}) == ""


def test_constants_are_folded():
    assert chat.Template("a{{ 'b' ~ 2 }}{% if 1 == 2 %}no{% else %}c{% endif %}").tree == [("text", "ab2c")]
    assert chat.fold(("and", ("const", 0), ("name", "x"))) == ("const", 0)


@pytest.mark.parametrize("rows", [[], [(1, 2, "assistant", "b"), (1, 1, "user", None), (None, 1, None, "x"), (1, 2, "assistant", "b"), (3, None, "assistant", "ü" * 300_000), (3, 1, "assistant", "### " * 100_000)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    parts = chat.format_conversations(df)
    got = {}
    for p in parts.collect():
        got.setdefault(p.conv_id, []).append(p)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [t for p in sorted(ps, key=lambda p: p.part) for t in chat.read_turns(p.text)] for c, ps in got.items()} == want
    assert not rows or len(got[3]) > 1
    digest = {r.conv_id: r.turns_sha256 for r in parts.mapInArrow(chat._read_parts, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").collect()}
    assert digest == {c: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in ts).encode()).hexdigest() for c, ts in want.items()}
