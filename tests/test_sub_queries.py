"""The registered sub-queries against a plain loop: every user turn counts, whatever its number."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def _want(rows):
    out, said, roles = set(), {}, {}
    for conv, _, role, text in sorted(rows, key=lambda r: r[:2]):
        roles.setdefault(conv, []).append(role)
        if role == "user":
            said.setdefault(conv, []).append(text)
    for conv, all_roles in roles.items():
        listed = [t for t in said.get(conv, [])[:8] if t.strip(" ")] or [" ".join(all_roles[:20])]
        out |= {(conv, i, t) for i, t in enumerate(listed)}
    return out


def test_all_user_turns(spark, tmp_path):
    rows = [("a", 1, "user", "one"), ("a", 2, "user", "two"), ("a", 3, "user", "three"), ("b", 0, "system", "x"), ("b", 1, "assistant", "y"), ("d", 4, "user", " "), ("d", 5, "tool", "z")]
    rows += [("c", i, "user", f"turn {i}") for i in range(12)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in entry.queries()["sub_queries"](spark, str(tmp_path)).collect())
    assert got == sorted(_want(rows))
    assert [q for c, _, q in got if c == "a"] == ["one", "two", "three"] and [q for c, _, q in got if c == "b"] == ["system assistant"]


def test_on_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in entry.queries()["sub_queries"](spark, SF).collect()]
    assert sorted(got) == sorted(_want(rows))
