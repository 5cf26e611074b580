"""Random sequences of operations against a plain model: dictionaries of rows per snapshot."""

import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from tidemark.operators import snapshots as snap
from tidemark.operators.changes import delete_partition, delete_where, update_where, upsert
from tidemark.operators.maintenance import compact, expire, set_partition_spec, stored_rows
from tidemark.operators.snapshots import read_at
from tidemark.operators.writes import append, create_history, load_history, overwrite

SCHEMA = "k long, g int, v long"
NAMES = ["append", "delete", "update", "upsert", "overwrite", "stage", "pick", "branch", "forward", "rollback",
         "compact", "expire", "spec", "reload", "update_all", "drop", "stage_drop"]

steps = st.lists(
    st.tuples(st.sampled_from(NAMES), st.integers(0, 5), st.sampled_from(["main", "main", "dev"])),
    min_size=4, max_size=9,
)


class Model:
    """What each snapshot must show. Rows are (unique number, k, g, v)."""

    def __init__(self):
        self.shows = {}
        self.parent = {}
        self.effect = {}  # snapshot -> (rows removed, rows added)
        self.refs = {"main": None}
        self.number = 0

    def fresh(self, values):
        out = frozenset((self.number + i, *v) for i, v in enumerate(values))
        self.number += len(out)
        return out

    def at(self, branch):
        return self.shows.get(self.refs[branch], frozenset())

    def commit(self, snapshot, branch, removed, added, staged=False):
        self.parent[snapshot] = self.refs[branch]
        self.effect[snapshot] = (frozenset(removed), frozenset(added))
        self.shows[snapshot] = (self.at(branch) - removed) | added
        if not staged:
            self.refs[branch] = snapshot

    def lineage(self, s):
        out = []
        while s is not None:
            out.append(s)
            s = self.parent[s]
        return out


def strip(rs):
    return sorted((r[1:] for r in rs), key=lambda r: tuple(str(v) for v in r))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(script=steps)
def test_every_kept_snapshot_reads_as_the_model_says(spark, script):
    play(spark, script)


def play(spark, script):
    def frame(values):
        return spark.createDataFrame(list(values), SCHEMA)

    m = Model()
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    first = [(k, k % 3, k * 10) for k in range(6)]
    path = tempfile.mkdtemp(prefix="tidemark-model-")
    h = create_history(frame(first), path + "/h", key=["k"], at=now)
    h = snap.enable_wap(h)
    m.commit(1, "main", frozenset(), m.fresh(first))
    next_key = 100
    origin = {}  # picked snapshot -> the staged one
    for name, n, branch in script:
        now += timedelta(hours=1)
        if branch not in m.refs:
            branch = "main"
        live, new = m.at(branch), h.next_snapshot_id
        hit = frozenset(r for r in live if r[2] == n % 3)
        changed = [(k, g, v + 1) for _, k, g, v in hit]
        if name == "append":
            values = [(next_key, n, 0), (next_key + 1, n % 3, 1)]
            next_key += 2
            h = append(h, frame(values), branch=branch, at=now)
            m.commit(new, branch, frozenset(), m.fresh(values))
        elif name == "delete":
            h = delete_where(h, f"g = {n % 3}", branch=branch, at=now)
            m.commit(new, branch, hit, frozenset())
        elif name == "update":
            h = update_where(h, {"v": "v + 1"}, f"g = {n % 3}", branch=branch, at=now)
            m.commit(new, branch, hit, m.fresh(changed))
        elif name == "update_all":
            h = update_where(h, {"v": "v + 1"}, branch=branch, at=now)
            m.commit(new, branch, live, m.fresh([(k, g, v + 1) for _, k, g, v in live]))
        elif name == "upsert":
            values = [*changed, (next_key, 7, n)]
            next_key += 1
            h, counts = upsert(h, frame(values), branch=branch, at=now)
            assert (counts.inserted, counts.updated, counts.unchanged) == (1, len(hit), 0)
            m.commit(new, branch, hit, m.fresh(values))
        elif name == "overwrite":
            h = overwrite(h, frame([(n, n, n)]), branch=branch, at=now)
            m.commit(new, branch, live, m.fresh([(n, n, n)]))
        elif name == "stage":
            h = update_where(h, {"v": "v + 1"}, f"g = {n % 3}", branch=branch, wap_id=f"w{new}", at=now)
            m.commit(new, branch, hit, m.fresh(changed), staged=True)
        elif name == "drop":
            h = delete_partition(h, "identity", "g", n % 3, branch=branch, at=now)
            m.commit(new, branch, hit, frozenset())
        elif name == "stage_drop":
            h = delete_partition(h, "identity", "g", n % 3, branch=branch, wap_id=f"w{new}", at=now)
            m.commit(new, branch, hit, frozenset(), staged=True)
        elif name == "pick":
            staged = [s for s, c in h.commits.items() if "wap.id" in c.summary and not c.expired]
            if not staged:
                continue
            s = staged[n % len(staged)]
            removed, added = m.effect[s]
            again = any(
                {s} & {t, origin.get(t)} for t in m.lineage(m.refs[branch]))
            if again or not removed <= live:
                with pytest.raises(ValueError):
                    snap.cherrypick(h, s, branch, at=now)
                continue
            h = snap.cherrypick(h, s, branch, at=now)  # no row conflicts, so it must go through
            if h.refs[branch] == s:
                m.refs[branch] = s
            else:
                m.commit(h.refs[branch], branch, removed, added)
                origin[h.refs[branch]] = s
        elif name == "branch":
            if "dev" in m.refs:
                h = snap.drop_branch(h, "dev")
                del m.refs["dev"]
            else:
                h = snap.create_branch(h, "dev", at=now)
                m.refs["dev"] = m.refs["main"]
        elif name == "forward" and "dev" in m.refs and m.refs["main"] in m.lineage(m.refs["dev"]):
            h = snap.fast_forward(h, "main", "dev", at=now)
            m.refs["main"] = m.refs["dev"]
        elif name == "rollback":
            line = [s for s in m.lineage(m.refs[branch]) if not h.commits[s].expired]
            h = snap.rollback(h, line[n % len(line)], branch, at=now)
            m.refs[branch] = line[n % len(line)]
        elif name == "compact":
            h, _ = compact(h, [1 << 20, 1500, 900][n % 3], branch=branch, at=now)  # small targets leave most files alone
            if h.refs[branch] != m.refs[branch]:
                m.commit(h.refs[branch], branch, frozenset(), frozenset())
        elif name == "expire":
            h, _ = expire(h, older_than=now - timedelta(hours=n % 3), retain_last=1 + n % 2)
        elif name == "spec":
            h = set_partition_spec(h, [[], [("identity", "g")]][n % 2])
        elif name == "reload":
            h = load_history(spark, h.path)
        assert h.refs == m.refs
    kept = [s for s, c in h.commits.items() if not c.expired]
    for s in kept:
        assert rows(read_at(h, snapshot_id=s)) == strip(m.shows[s]), (s, script)
        assert h.commits[s].summary["total_rows"] == str(len(m.shows[s]))
    h, _ = compact(h, 1 << 20, at=now)
    h, _ = expire(h, older_than=now + timedelta(hours=1))
    assert rows(read_at(h)) == strip(m.at("main"))
    if set(h.refs) == {"main"}:
        assert stored_rows(h).count() == len(m.at("main"))
