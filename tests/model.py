"""The commands, line by line over text: what the DataFrames have to agree with."""

from __future__ import annotations

import re
from collections import defaultdict

U32 = 2**32 - 1


def number(text):
    return int(text) if re.fullmatch(r"[0-9]+", text) and int(text) <= U32 else None


class Plain:
    def __init__(self, text: str, attribute="gene_name", skipped="region"):
        self.lines, self.features, off = [], [], 0
        for line in text.split("\n")[: None if not text.endswith("\n") else -1]:
            self.lines.append((off, line))
            stripped = line.strip()
            if line and not line.startswith("#") and stripped:
                f = stripped.split("\t")
                if f[2] not in skipped.split(",") and int(f[4]):
                    s, e = sorted((int(f[3]), int(f[4])))
                    key = lambda k, stop: (m := re.search(re.escape(k) + f"=([^{stop}]+)", stripped)) and m[1]
                    self.features.append((off, f[0], max(s - 1, 0), e, key("ID", r";\s"), key("Parent", r";\s"), key(attribute, ";")))
            off += len(line.encode()) + 1
        self.size, self.attribute = len(text.encode()), attribute
        self.fid = {f[4]: f[0] for f in self.features}
        self.par = {f[0]: self.fid.get(f[5], self.fid[f[4]]) for f in self.features}
        self.spans = [(f[0], self.fid[f[4]], f[1], f[2], f[3]) for f in self.features if self.par[f[0]] == self.fid[f[4]]]
        starts = [s[0] for s in self.spans]
        self.block = {}  # of each number, the last
        for (b0, fid, *_), b1 in zip(self.spans, [*starts[1:], self.size]):
            self.block[fid] = (b0, b1)

    def root(self, n):
        seen = set()
        while self.par[n] != n:
            if n in seen:
                return None
            seen.add(n)
            n = self.par[n]
        return n

    def in_block(self, fid):
        if fid not in self.block:
            return []
        a, b = self.block[fid]
        return [(o, x) for o, x in self.lines if a <= o < b]

    def hits(self, regions):
        return [(r, s) for r in regions for s in self.spans if s[2] == r[1] and s[3] < r[3] and s[4] > r[2]]

    def intersect(self, regions, mode, invert, entire, types):
        test = {"overlap": lambda s, e, a, b: True, "contained": lambda s, e, a, b: s >= a and e <= b, "contains": lambda s, e, a, b: s <= a and e >= b}[mode]
        roots = {s[1] for r, s in self.hits(regions) if test(s[3], s[4], r[2], r[3]) != invert}
        known, out = {s[2] for s in self.spans}, set()
        closed = test if mode != "overlap" else lambda s, e, a, b: a <= s <= b or a <= e <= b or s <= a <= e or s <= b <= e
        for fid in roots:
            for o, x in self.in_block(fid):
                if entire and types is None:
                    out.add(o)
                    continue
                f = x.split("\t")
                if not x or x.startswith("#") or len(f) < 6 or (types is not None and f[2] not in types):
                    continue
                s, e = number(f[3]), number(f[4])
                if s is not None and e is not None and any(r[1] == f[0] and f[0] in known and closed(s, e, r[2], r[3]) for r in regions):
                    out.add(o)
        return sorted(out)

    def kept(self, keep, key, entire, types):
        out = set()
        for fid in {f for f, _ in keep}:
            for o, x in self.in_block(fid):
                if entire and types is None:
                    out.add(o)
                    continue
                x = x.removesuffix("\r")
                f = x.split("\t", 8)
                if x.startswith("#") or len(f) < 9 or (types is not None and f[2] not in types) or key + "=" not in f[8]:
                    continue
                if (fid, f[8].split(key + "=", 1)[1].split(";")[0]) in keep:
                    out.add(o)
        return sorted(out)

    def extract(self, ids, entire, types):
        keep = {(self.root(self.fid[i]), i) for i in ids if i in self.fid}
        return self.kept({k for k in keep if k[0] is not None}, "ID", entire, types)

    def search(self, pattern, entire, types):
        keep = {(self.root(f[0]), f[6]) for f in self.features if f[6] is not None and re.search(pattern, f[6])}
        return self.kept({k for k in keep if k[0] is not None}, self.attribute, entire, types)

    def quantify(self, regions):
        """(coverage, depth) by id."""
        regions = [r for r in regions if r[2] < r[3]]
        by_root = defaultdict(set)
        for r, s in self.hits(regions):
            by_root[s[1]].add(r)
        cov, deep = {}, {}
        for fid, found in sorted(by_root.items(), key=lambda kv: self.block[kv[0]]):
            ids = defaultdict(list)
            for _, x in self.in_block(fid):
                f = x.split("\t", 8)
                if not x or x.startswith("#") or len(f) < 9 or number(f[3]) is None or number(f[4]) is None or not number(f[4]) or "ID=" not in f[8]:
                    continue
                s, e = sorted((int(f[3]), int(f[4])))
                ids[re.split("[; \t]", f[8].split("ID=", 1)[1])[0]].append((f[0], max(s - 1, 0), e))
            for i, rows in ids.items():
                bases = {p for _, s, e in rows for r in found for p in range(max(s, r[2]), min(e, r[3]))}
                old = cov.get(i)
                new = (rows[0][0], min(s for _, s, _ in rows), max(e for *_, e in rows), len(bases))
                cov[i] = new if old is None else (old[0], min(old[1], new[1]), max(old[2], new[2]), old[3] + new[3])
                hit = [(s, e, r) for _, s, e in rows for r in found if s < r[3] and e > r[2]]
                if hit:
                    new, old = (rows[0][0], min(h[0] for h in hit), max(h[1] for h in hit), len({h[2] for h in hit})), deep.get(i)
                    deep[i] = new if old is None else (old[0], min(old[1], new[1]), max(old[2], new[2]), old[3] + new[3])
        return cov, deep
