import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators.orphans import ForeignKey, Table, orphan_cascade, orphan_report

T0 = datetime(2024, 1, 31, 12)
COLS = "doc_id bigint, id string, ref string, other string, t timestamp, loaded_at timestamp, deleted_at timestamp"


def direct_orphans(tables, fks):
    return orphan_cascade(tables, fks).direct


def _tables(spark, rows):
    return {n: Table(n, spark.createDataFrame(r, COLS), "id", "t", deleted="deleted_at") for n, r in rows.items()}


def _row(d, i, ref=None, other=None, at=0, gone=None):
    return (d, i, ref, other, T0 + timedelta(days=at), T0 + timedelta(days=at), None if gone is None else T0 + timedelta(days=gone))


def test_each_reason(spark):
    rows = {
        "p": [_row(1, "in"), _row(1, "late", at=9), _row(1, "gone", gone=1), _row(1, "gone", gone=5), _row(1, "stays", gone=8), _row(2, "other"), _row(1, "copy", at=9), _row(1, "copy", at=1)],
        "c": [_row(1, f"c-{x}", x, at=2) for x in ("in", "late", "gone", "stays", "other", "copy", "", None, "nowhere")] + [_row(1, "c-late", "late", at=20), _row(1, "c-in", "in", at=3)],
    }
    # the copy of c-late that comes later does not save it, for its earliest arrival counts; its month differs, so it is a row of its own
    got = {(r["record_id"], r["period"]) for r in direct_orphans(_tables(spark, rows), [ForeignKey("c", "ref", "p")]).collect()}
    assert got == {("c-late", "2024-02"), ("c-gone", "2024-02"), ("c-other", "2024-02"), ("c-nowhere", "2024-02")}


def test_cascade_against_brute_force(spark):
    rnd = random.Random(8)
    names = ["a", "b", "c"]
    rows = {n: [_row(rnd.randrange(2), f"{n}{i}", f"{p}{rnd.randrange(40)}", f"b{rnd.randrange(40)}" if n == "b" else None, rnd.randrange(3), rnd.choice([None, None, 4])) for i in range(30)] for n, p in zip(names, ["z", "a", "b"])}
    fks = [ForeignKey("b", "ref", "a"), ForeignKey("b", "other", "b"), ForeignKey("c", "ref", "b")]
    out = orphan_cascade(_tables(spark, rows), fks)

    def parent(t, d, k):
        hit = [r for r in rows[t] if r[0] == d and r[1] == k]
        return hit and (min(r[5] for r in hit), min([r[6] for r in hit if r[6]], default=None))

    direct, refs = set(), []
    for k in fks:
        for r in rows[k.child]:
            ref = r[2] if k.column == "ref" else r[3]
            if not ref:
                continue
            refs.append((k, r, ref))
            hit = parent(k.parent, r[0], ref)
            if not hit or hit[0] > r[5] or hit[1] and hit[1] <= r[5]:
                direct.add((r[0], k.child, k.column, r[1]))
    gone, inherited = {(d, t, i) for d, t, _, i in direct}, {}
    frontier, level = set(gone), 0
    while frontier:
        level += 1
        step = {(r[0], k.child, k.column, r[1]) for k, r, ref in refs if (r[0], k.parent, ref) in frontier} - direct - set(inherited)
        inherited |= dict.fromkeys(step, level)
        frontier = {(d, t, i) for d, t, _, i in step} - gone
        gone |= frontier
    keys = ("s0", "table_name", "field_name", "record_id")
    assert {tuple(r[k] for k in keys) for r in out.direct.collect()} == direct
    assert {tuple(r[k] for k in keys): r["level"] for r in out.inherited.collect()} == inherited
    assert max(inherited.values()) > 1
    total = {r["table_name"]: 0 for r in orphan_report(out).collect()}
    for r in orphan_report(out).collect():
        total[r["table_name"]] += r["direct_orphans"] + r["inherited_orphans"]
    assert sum(total.values()) == len(direct) + len(inherited)


def test_hot_reference_and_empty_tables(spark):
    rows = {"p": [_row(1, "hub")], "c": [_row(1, f"c{i}", "hub" if i % 3 else "void", at=1) for i in range(3000)]}
    fks = [ForeignKey("c", "ref", "p")]
    assert direct_orphans(_tables(spark, rows), fks).count() == 1000
    empty = _tables(spark, {"p": rows["p"][:1], "c": rows["c"][:1]})
    empty = {n: Table(n, t.df.limit(0), "id", "t", deleted="deleted_at") for n, t in empty.items()}
    assert direct_orphans(empty, fks).isEmpty()
    none = {"p": empty["p"], "c": _tables(spark, rows)["c"]}
    assert direct_orphans(none, fks).count() == 3000
    cascade = orphan_cascade(none, fks)
    assert cascade.levels == 0 and cascade.inherited.isEmpty()


def test_a_limit_of_levels_raises(spark):
    rows = {"a": [_row(1, "a0", "nowhere", at=1), *(_row(1, f"a{i}", f"a{i - 1}", at=1) for i in range(1, 4))]}
    fks = [ForeignKey("a", "ref", "a")]
    assert orphan_cascade(_tables(spark, rows), fks, max_levels=3).inherited.count() == 3
    with pytest.raises(RuntimeError):
        orphan_cascade(_tables(spark, rows), fks, max_levels=2)


def test_hot_records_at_every_level(spark):
    """A hub that is orphaned takes all its children along, though a third of all rows refer to it."""
    rows = {
        "p": [_row(1, "root")],
        "c": [_row(1, "hub", "void", at=1), _row(1, "fine", "root", at=1), *(_row(1, f"c{i}", "root", at=1) for i in range(2000))],
        "g": [_row(1, f"g{i}", "hub" if i % 3 else "fine", at=2) for i in range(3000)],
    }
    out = orphan_cascade(_tables(spark, rows), [ForeignKey("c", "ref", "p"), ForeignKey("g", "ref", "c")])
    assert {r["record_id"] for r in out.direct.collect()} == {"hub"}
    assert out.inherited.count() == 2000 and out.levels == 1


def test_null_documents_and_clashing_names(spark):
    rows = {"p": [_row(None, "x")], "c": [_row(None, "c1", "x", at=1), _row(1, None, "x", at=1), _row(1, "c3", "x", at=1), _row(1, "c3", "x", at=1)]}
    tables = {n: Table(n, t.df.selectExpr("*", "1 as hot", "2 as s0", "3 as parent", "'k' as key"), "id", "t", deleted="deleted_at") for n, t in _tables(spark, rows).items()}
    # a null document scopes nothing, so its references lead nowhere; a record without an id is reported but has no children
    assert sorted(str(r["record_id"]) for r in direct_orphans(tables, [ForeignKey("c", "ref", "p")]).collect()) == ["None", "c1", "c3"]
