"""Weak candidates are not kept company by what overlaps them."""

from __future__ import annotations

from tradewind.llm import secrets

KEY = "Zx9aB8cD7eF6gH5iJ4kL3"
LINK = "https://blog.example.com/2024/How-To-Bake-Bread-At-Home"


def test_parts_that_overlap_are_no_company(spark):
    rows = [
        (1, f"See {LINK} there"),
        (2, "login: Abc123Def456Ghi789Jk"),
        (3, f"{LINK} {LINK}"),
        (4, f"login: alice99 {KEY}"),
        (5, f"{KEY} {LINK}"),
        (6, f"login: alice99 {'x ' * 150}{KEY}"),
        (7, f"login: abc/{KEY}"),
        (8, f"login: abc/{KEY} host: db.example.com"),
    ]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] == got[3] == got[6] == got[7] == ""
    assert got[4] == "id:0:14,mixed:15:36"
    assert got[5] == "mixed:0:21"
    assert got[8] == "mixed:7:32"
