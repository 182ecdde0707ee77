"""Random small annotations: the DataFrames against the line-by-line model."""

import random

import pytest

from strandline.plans import commands as c
from strandline.plans.model import build_index
from tests.model import Plain


def annotation(seed):
    r = random.Random(seed)
    ids, lines, top = [f"f{i}" for i in range(24)], ["##gff-version 3"], r.choice([60, 3000, 40_000])
    for _ in range(r.randrange(5, 45)):
        kind = r.random()
        if kind < 0.06:
            lines.append(r.choice(["###", "# note", "", "   "]))
            continue
        s = r.randrange(1, top)
        e = r.choice([s + r.randrange(60), s - r.randrange(40), s + r.randrange(top), 0 if r.random() < 0.3 else s])
        attrs = f"ID={r.choice(ids)}" + r.choice(["", " b"])
        if r.random() < 0.6:
            attrs += f";Parent={r.choice([*ids, 'gone', 'f1,f2'])}"
        if r.random() < 0.5:
            attrs = r.choice([f"{attrs};gene_name=N{r.randrange(5)}", f"old_gene_name=N{r.randrange(5)};{attrs}", f"{attrs};gene_name=N1 x;more=1", f"geneID=f{r.randrange(9)};{attrs}"])
        lines.append("\t".join([f"chr{r.randrange(3)}", "s", r.choice(["gene", "exon", "CDS", "region"]), str(s), str(max(e, 0)), ".", "+", ".", attrs]))
    end = r.choice(["\n", "\r\n"])
    text = end.join(lines) + r.choice([end, ""])
    regions = []
    for i in range(r.randrange(0, 100)):
        s = r.randrange(top)
        regions.append((i, f"chr{r.randrange(4)}", s, s + r.choice([0, 1, r.randrange(50), r.randrange(top), -r.randrange(5)])))
    return text, [x for x in regions if x[3] >= 0], [r.choice([*ids, "gone"]) for _ in range(5)]


@pytest.mark.parametrize("seed", range(8))
def test_against_the_model(spark, tmp_path, seed):
    text, regions, ids = annotation(seed)
    (tmp_path / "a.gff").write_bytes(text.encode())
    plain, found = Plain(text), build_index(spark, str(tmp_path / "a.gff"), skip_types="region", save=f"file://{tmp_path}/index")
    offs = lambda df: sorted(x.off for x in df.collect())
    assert {x.off: x.par for x in found.links.collect()} == plain.par
    assert {x.node: x.root for x in found.roots.collect()} == {n: plain.root(n) for n in plain.par}
    assert {(b.fid, b.b0, b.b1) for b in found.blocks.collect() if plain.block[b.fid][0] == b.b0} == {(f, *b) for f, b in plain.block.items()}
    table = spark.createDataFrame(regions, "rid long, seqid string, qs long, qe long")
    for mode, invert, entire, types in (("overlap", False, False, None), ("overlap", False, True, None), ("contained", True, False, None), ("contained", False, True, None), ("contains", False, False, "exon,gene"), ("contains", True, True, None)):
        want = plain.intersect(regions, mode, invert, entire, types and types.split(","))
        assert offs(c.intersect(found, table, mode, invert, entire, types)) == want, (mode, invert, entire, types)
    wanted = spark.createDataFrame([(i,) for i in ids], "value string")
    for entire, types in ((False, None), (True, None), (False, "exon")):
        assert offs(c.extract(found, wanted, entire, types)) == plain.extract(ids, entire, types)
        assert offs(c.search(found, patterns=["N[12]", "3$"], entire=entire, types=types)) == plain.search("N[12]|3$", entire, types)
    cov, deep = plain.quantify(regions)
    got = c.coverage(found, table).collect()
    assert {x.id: (x.start, x.end, x.breadth) for x in got} == {i: v[1:] for i, v in cov.items()}
    assert all(abs(x.fraction - x.breadth / (x.end - x.start)) < 1e-12 for x in got)
    assert {x.id: (x.start, x.end, x.depth) for x in c.depth(found, table).collect()} == {i: v[1:] for i, v in deep.items()}
