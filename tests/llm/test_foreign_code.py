import random

import pytest

from siltstone.llm import foreign_code as S

WORDS = "lease table crawler policy noted archive queue reader brief verify rows before restart holds signal token nightly orphan quota mirror".split()


def module(rng, names=None):
    """A hand-written looking module: one skeleton, its own remarks."""
    names = names or rng.sample("alpha beta gamma delta kappa sigma omega theta".split(), 4)
    parts = []
    for i in range(3):
        note = " ".join(rng.choice(WORDS) for _ in range(18))
        parts.append(f'def {names[i]}_{names[3]}(item, limit=None):\n    """{note}."""\n    if not item:\n        return None\n    return {names[i + 1 - 1]}(item, {rng.randint(1, 99)})\n')
    return "import json\n\n" + "\n".join(parts)


def flags(path, body):
    j = S.judged(path, body)
    return {k for k in ("banner", "upstream", "lock", "dense", "data") if j[k]}


def test_single_files():
    rng = random.Random(1)
    own = module(rng)
    assert flags("a/src/x.py", own) == set()
    assert flags("a/src/x.py", "# Copyright (c) 2023 Some Cooperative. Internal use.\n\n" + own) == set()
    assert flags("a/src/x.py", "# The report below is generated by token at runtime; edited by hand.\n" + own) == set()
    assert flags("a/tools/x.py", "# Writes client stubs. The emitter puts a 'DO NOT EDIT' banner on top of each file.\n" + own) == set()
    assert flags("a/src/x.js", "// sources: " + " ".join(f"https://d.example/{i}" for i in range(40)) + "\n\n" + "export function a(b) {\n  return b;\n}\n" * 4) == set()
    for banner in ("# Code generated by stubmaker. DO NOT EDIT.", "# @generated by kbgen from a.proto", "# <auto-generated> by wirec </auto-generated>", "# Generated from a.proto by grammarc 1.7", "# AUTOGENERATED FILE - edit a.yaml instead", "# This file was automatically created by wirec; manual changes will be lost", "# Automatisch erzeugt aus a.g4 - nicht von Hand ändern."):
        assert "banner" in flags("a/src/x.py", banner + "\n" + own), banner
    for notice in ("# SPDX-License-Identifier: MIT", "# lib v1.2.3\n# Copyright (c) 2014 the lib authors. Released under the MIT license.", "# lib 1.2.3 -- MIT"):
        assert "upstream" in flags("a/src/x.py", notice + "\n\n" + own)
    assert "data" in flags("a/src/x.ts", 'export default [{"id":0,"w":"vault","v":[48,91]},{"id":1,"w":"pebble","v":[1,2]},{"id":3,"w":"x","v":[4,5]}];')
    assert "data" in flags("a/db/x.sql", "\n".join(f"INSERT INTO t VALUES ({i}, 'a', {i * 7}, 'b{i}');" for i in range(20)))
    assert "dense" in flags("a/js/x.js", "!function(e,t){" + "if(a&&b){c=d[e]||{}}else f=null;" * 40 + "}()")
    assert "lock" in flags("a/package-lock.json", '{\n "lockfileVersion": 3\n}') and flags("a/x.py", "") == set()


def test_minhash_finds_near_copies():
    rng = random.Random(3)
    tokens = [rng.choice(WORDS) for _ in range(300)]
    near = tokens[:150] + ["x"] + tokens[151:]
    far = [rng.choice(WORDS) for _ in range(300)]
    a, b, c = (S.bands(S.shingles(t)) for t in (tokens, near, far))
    assert sum(x == y for x, y in zip(a, b, strict=True)) > 4 and sum(x == y for x, y in zip(a, c, strict=True)) == 0
    assert S.bands(S.shingles([])) == []


def test_clusters(spark):
    rng = random.Random(5)
    rows = [(f"own{i}", "r", f"p{i}/src/m.py", module(rng)) for i in range(30)]
    shared = module(rng)
    rows += [("own-copy-1", "r", "p1/lib/z.py", shared), ("own-copy-2", "r", "p2/lib/z.py", shared)]
    library = module(rng, ["alpha", "beta", "gamma", "delta"])
    renamed = library.replace("alpha", "uno").replace("delta", "due")
    rows += [("lib1", "r", "p1/third_party/l/a.py", library), ("lib2", "r", "p2/lib/l.py", "# SPDX-License-Identifier: MIT\n\n" + library), ("lib3", "r", "p3\\src\\util\\other.py", renamed)]
    table = lambda n: "class V:\n" + "".join(f"    self.{rng.choice(WORDS)}{i} = Label({rng.randint(1, 99)}); self.x{i}.y = Point({i}, {i})\n" for i in range(n))
    rows += [(f"gen{i}", "r", f"p4/forms/v{i}.py", ("# Code generated by stubmaker. DO NOT EDIT.\n" if i else "") + table(12)) for i in range(4)]
    rows += [("empty", "r", "p1/src/e.py", None), ("vendored-empty", "r", "p1/node_modules/e/x.js", ""), ("nopath", "r", None, module(rng)), ("lib1", "r", "p1/third_party/l/a.py", library)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "asset_id string, root_id string, path string, body string, set_id string")
    found = {r["asset_id"]: r for r in S.foreign_files(frame).collect()}
    assert set(found) == {"lib1", "lib2", "lib3", "vendored-empty", "gen0", "gen1", "gen2", "gen3"}
    assert found["lib3"]["vendored"] and (found["gen0"]["generated"] or found["gen0"]["data"])
    assert S.foreign_files(frame.limit(0)).count() == 0


@pytest.mark.parametrize("path", ["a/src/vendors/x.py", "a/app/vendor_rating/x.py", "a/src/distance/x.py", "a/src/generated_report.py", "a/build/x.py", "a/external/notes.py"])
def test_paths_that_only_sound_foreign(path):
    assert not S.FOREIGN_DIRS.search(path) and not S.TOOL_PATH.search(path) and not S.LOCKS.search(path)


def test_copies_are_found_among_half_alike_boilerplate(spark):
    """A pair of copies whose buckets all have leaders from a family that shares the boilerplate only."""
    import numpy as np

    rng = np.random.RandomState(2)
    fresh = lambda k: rng.randint(-(2**62), 2**62, size=k).tolist()
    boiler = fresh(70)
    family = [boiler + fresh(30) for _ in range(120)]
    copied = boiler + fresh(30)
    sets = [*family, copied, copied[:-6] + fresh(6)]
    rows = [(f"a{i}", f"r/{i}", False, i == 120, False, False, f"s{i}", sorted(h), [0, 1, 2]) for i, h in enumerate(sets)]
    found = {r["set_id"]: r["upstream_share"] for r in S.clusters(spark.createDataFrame(rows, S.FILE)).collect()}
    assert len(found) == 122 and {k for k, v in found.items() if v >= S.UPSTREAM_SHARE} == {"s120", "s121"}


def test_marks_behind_a_long_head_comment():
    own = module(random.Random(1))
    long = "\n".join(f"# remark {i} on the tables that the crawler verifies before the nightly restart of the archive" for i in range(30))
    assert "banner" in flags("a/src/x.py", f"{long}\n# Code generated by stubmaker. DO NOT EDIT.\n{own}")
    assert "upstream" in flags("a/src/x.py", f"{long}\n# SPDX-License-Identifier: MIT\n\n{own}")
    assert "lock" in flags("a/other.json", '{\n "x": "' + "y" * 3000 + '",\n "lockfileVersion": 3\n}')


def test_clusters_decide_without_marks(spark):
    """Families, copies over repositories and literal-only clusters are found though no file carries a mark; recorded copies are the project's own."""
    rng = random.Random(11)
    rows = [(f"own{i}", "r", f"p{i}/src/m.py", module(rng), None) for i in range(12)]
    kept = module(rng)
    rows += [(f"kept{i}", "r", f"p{i}/src/k.py", kept, "kept0" if i else None) for i in range(5)]
    library = module(rng)
    rows += [(f"lib{i}", "r", f"p{i}/src/util.py", library, None) for i in range(3)]
    form = lambda i: "class V:\n" + "".join(f"    self.{rng.choice(WORDS)}{k}{i} = Label({k}); self.x{k}.y = Point({k}, {i})\n" for k in range(7)) + "    return build(self)\n"
    rows += [(f"form{i}", "r", f"p4/forms/v{i}.py", form(i), None) for i in range(4)]
    rows += [(f"blob{i}", "r", f"p{i}/src/t.js", f"export default [{', '.join(str(rng.randint(100000, 999999)) for _ in range(40))}];", None) for i in range(3)]
    rows += [(f"pair{i}", "r", f"p{i}/src/q.py", module(random.Random(77)), None) for i in range(2)]
    frame = spark.createDataFrame(rows, "asset_id string, root_id string, path string, body string, copy_of string")
    seen = S.file_evidence(frame)
    told = {r["asset_id"]: {k for k in ("family", "spread", "blob") if r[k]} for r in seen.join(S.clusters(seen), "set_id").where("not banner and not upstream and not foreign").collect()}
    assert all("spread" in told[f"lib{i}"] for i in range(3)) and all("family" in told[f"form{i}"] for i in range(4)) and all("blob" in told[f"blob{i}"] for i in range(3))
    assert not any(v for k, v in told.items() if k.startswith(("own", "kept", "pair")))
    found = {r["asset_id"] for r in S.foreign_files(frame).collect()}
    assert found == {*(f"lib{i}" for i in range(3)), *(f"form{i}" for i in range(4)), *(f"blob{i}" for i in range(3))}


def test_every_pair_alike_is_linked(spark):
    """Against brute force: two sets alike to 0.8 always end in one component, and sets of one component are joined by such pairs."""
    import numpy as np

    rng = np.random.RandomState(4)
    sets = []
    for _ in range(25):
        base = rng.randint(-(2**62), 2**62, size=rng.randint(8, 120)).tolist()
        for _ in range(rng.randint(1, 8)):
            gone = rng.randint(0, max(1, len(base) // 4))
            sets.append(sorted({*base[gone:], *rng.randint(-(2**62), 2**62, size=rng.randint(0, max(1, len(base) // 8))).tolist()}))
    frame = spark.createDataFrame([(i, h, S.bands(np.array(h, dtype=np.int64).view(np.uint64))) for i, h in enumerate(sets)], "n long, hashes array<long>, bands array<long>")
    got = {r["n"]: r["component"] for r in S.links(frame).collect()}
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len({*sets[i]} & {*sets[j]})
            if shared * 100 >= S.SIMILAR_PERCENT * (len(sets[i]) + len(sets[j]) - shared):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    want = {i: top(i) for i in range(len(sets))}
    assert {i: got.get(i, i) for i in want} == want and len({*want.values()}) < len(sets) - 30
