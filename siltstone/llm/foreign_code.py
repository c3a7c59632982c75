"""Generated, minified, vendored and data-like source files (problem 6).

A file becomes the set of its shingles of five tokens, with identifiers and numbers masked and
the words of comments kept: copies of a library agree even where names were changed, while the
skeleton that all files of a language share stays far below the threshold. Files with equal
sets are one representative. Representatives are bucketed by MinHash bands and compared with
the bucket's leader; what the leaders leave apart is joined exactly over the rarest shingles of
each set. A pair counts when the sets agree to 0.8, and a cluster is a component of such pairs.

Clusters decide by themselves. Copies that the catalogue records as such (canonical_asset_id)
are the project's own and are set aside; ``RELATIVES`` or more files that still agree did not
come about by hand: with one text in several repositories they are vendored, with different
texts a family that a tool wrote, and literal-only ones are data. A smaller cluster follows the
banners and upstream notices of its members, and a file without relatives is judged by itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.search import small
from siltstone.operators.similarity import connected_components
from siltstone.session import cut_lineage
from siltstone.tables import latest, table

SHINGLE = 5
SIMILAR_PERCENT = 80
SIMILARITY = SIMILAR_PERCENT / 100
#: Slots of the table of shingle frequencies; its size does not grow with the corpus.
SLOTS = 1 << 20
BANDS, ROWS = 16, 4
#: So many files that agree, recorded copies aside, are no work by hand; two may be a copy nobody recorded.
RELATIVES = 3
#: Bits of a set's sketch, of which two sets alike to s agree in (1 + s) / 2 on average, and the least
#: agreement at which a pair is compared: six deviations below that of the threshold, so that it
#: drops a pair alike with a chance below one in a billion.
SKETCH = 256
AGREE = int(SKETCH * (1 + SIMILARITY) / 2 - 6 * (SKETCH * (1 + SIMILARITY) / 2 * (1 - SIMILARITY) / 2) ** 0.5)
#: Shares of a cluster's files that must carry the mark for the rest to be told by it.
BANNER_SHARE, UPSTREAM_SHARE = 0.2, 0.2
LITERAL_SHARE = 0.7
REPEATED_LINE_SHARE, REPEATED_LINES = 0.6, 8
LONG_LINE, DENSE = 250, 0.12

#: Words with which tools and authors mark files.
BANNER = re.compile(
    r"(?:<auto-?generated\b|@generated\b|auto-?generated\b|(?:this (?:file|code|module) )?(?:was |is )?(?:automatically |auto-?)?(?:code )?(?:generated|created|produced) (?:automatically |by |from |with |using )\S"
    r"|this (?:file|code|module) (?:was|is|has been) (?:automatically|auto|machine)[ -]?(?:generated|created|produced)|code generated\b|machine generated\b|do not (?:edit|modify)\b"
    r"|(?:diese datei wurde )?automatisch (?:erzeugt|generiert|erstellt)|fichier (?:généré|créé) automatiquement|ce fichier (?:a été|est) généré|(?:archivo )?generado automáticamente|generated file\b)",
    re.I,
)
UPSTREAM = re.compile(
    r"SPDX-License-Identifier|\b(?:released|licen[cs]ed|distributed|available) under (?:the |a )?\S+|\b(?:MIT|BSD|Apache|ISC|MPL|LGPL|GPL)[\w .-]{0,14}\bLicen[cs]e\b|\bupstream copy\b|--\s*(?:MIT|BSD|Apache|ISC|MPL)\b|^\s*(?:/\*!|//|#)\s*\S+ v\d+\.\d+\.\d+\s*$",
    re.I | re.M,
)
OWN = re.compile(r"\binternal use\b|\bproprietary\b|\ball rights reserved\b", re.I)
FOREIGN_DIRS = re.compile(
    r"(?:^|/)(?:(?i:vendor|_vendor|third[_-]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|godeps)|(?i:external)/(?:[\w.-]*\d[\w.-]*|[A-Z][\w.]+)|deps/[\w.-]+-\d[\w.]*|packages/[\w.-]+\.\d[\w.]*|lib/[\w-]+-\d+\.\d[\w.]*)(?:/|$)"
)
TOOL_PATH = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h)|\.g\.(?:cs|dart)|\.designer\.cs|\.generated\.\w+|\.graphql\.tsx?|/__generated__/[^/]+)$", re.I)
LOCKS = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pipfile\.lock|uv\.lock|go\.sum|composer\.lock|gemfile\.lock|packages\.lock\.json|mix\.lock|pubspec\.lock|podfile\.lock)$", re.I)
LOCK_BODY = re.compile(r"\"lockfileVersion\"|^# This file is automatically @generated by Cargo|\"_meta\":\s*\{\s*\"hash\"", re.M)
KEYWORDS = frozenset(
    """and as async await break case catch class const continue def default defer del delete do elif else elseif enum except export extends extern false finally fn for foreach from func function
    global go if impl implements import in interface internal is lambda let loop match mod module mut namespace new nil none not null of or package param pass private protected pub public raise range readonly
    return sealed select self static struct super switch this throw trait true try type typeof union unsafe use using var void where while with yield create replace view table insert into values update set
    alter add constraint primary key join left inner group by order on having distinct begin end int string bool""".split()
)
HASH_COMMENTS = frozenset("py ps1 rb sh bash yaml yml toml r pl tf".split())
DASH_COMMENTS = frozenset("sql lua hs".split())

_STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
_SLASH = r"/\*.*?(?:\*/|\Z)|(?<![:\w])//[^\n]*"
LEXERS = {
    "hash": re.compile(rf"(?P<long>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|(?P<note>#[^\n]*)|(?P<text>{_STRING})|(?P<num>\b\d[\w.]*)|(?P<id>[^\W\d]\w*)|(?P<op>[^\w\s])", re.S),
    "dash": re.compile(rf"(?P<note>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{_STRING})|(?P<num>\b\d[\w.]*)|(?P<id>[^\W\d]\w*)|(?P<op>[^\w\s])", re.S),
    "slash": re.compile(rf"(?P<note>{_SLASH})|(?P<text>{_STRING})|(?P<num>\b\d[\w.]*)|(?P<id>[^\W\d]\w*)|(?P<op>[^\w\s])", re.S),
}
WORD = re.compile(r"[^\W\d_]+")


def normal_path(path: str | None) -> str:
    return (path or "").replace("\\", "/")


def lexer_of(path: str) -> re.Pattern:
    extension = path.rpartition(".")[2].lower()
    return LEXERS["hash" if extension in HASH_COMMENTS else "dash" if extension in DASH_COMMENTS else "slash"]


def kind_of(m: re.Match) -> str:
    """The kind of a token; a long string that begins its line is a remark."""
    if m.lastgroup == "long" and not m.string[m.string.rfind("\n", 0, m.start()) + 1 : m.start()].strip():
        return "doc"
    return m.lastgroup


def masked(path: str, body: str) -> tuple[list[str], list[str], int, int]:
    """Masked tokens without the head comment, the head comment's lines, characters of literals and of literals and names."""
    tokens: list[str] = []
    head: list[str] = []
    literal = code = 0
    lines = body.count("\n")
    for m in lexer_of(path).finditer(body):
        kind, seen = kind_of(m), m[0]
        if kind in ("note", "doc"):
            if not tokens and kind == "note":
                head += seen.split("\n")
            elif kind == "note" and len(head) < 12 and body.count("\n", 0, m.start()) < 12 and lines:
                head += seen.split("\n")[:3]
                tokens += [w.lower() for w in WORD.findall(seen)]
            else:
                tokens += [w.lower() for w in WORD.findall(seen)]
            continue
        size = len(seen)
        code += size if kind != "op" else 0
        if kind in ("text", "long"):
            literal += size
            tokens.append("S")
        elif kind == "num":
            literal += size
            tokens.append("N")
        elif kind == "id":
            low = seen.lower()
            tokens.append(low if low in KEYWORDS else "I")
        else:
            tokens.append(seen)
    return tokens, head, literal, code


def shingles(tokens: list[str]) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; of a shorter file its one shingle."""
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    size = min(SHINGLE, len(tokens))
    grams = {" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}
    return np.array(sorted(int.from_bytes(hashlib.blake2b(g.encode("utf-8", "replace"), digest_size=8).digest(), "little") for g in grams), dtype=np.uint64)


_RNG = np.random.RandomState(20240501)
_MULTIPLY = _RNG.randint(1, 2**63 - 1, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_ADD = _RNG.randint(0, 2**63 - 1, size=BANDS * ROWS, dtype=np.int64).astype(np.uint64)
_SKETCH_MULTIPLY = _RNG.randint(1, 2**63 - 1, size=SKETCH, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SKETCH_ADD = _RNG.randint(0, 2**63 - 1, size=SKETCH, dtype=np.int64).astype(np.uint64)


def least_of(hashes: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The minimum of the set under each linear map."""
    least = np.full(len(multiply), ~np.uint64(0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 1024):
            least = np.minimum(least, ((hashes[None, i : i + 1024] * multiply[:, None] + add[:, None]) >> np.uint64(8)).min(axis=1))
    return least


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of each of ``SKETCH`` minima, as 64-bit integers."""
    if not len(hashes):
        return np.zeros(SKETCH // 64, dtype=np.int64)
    return np.packbits((least_of(hashes, _SKETCH_MULTIPLY, _SKETCH_ADD) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def bands(hashes: np.ndarray) -> list[int]:
    """One bucket id per band, from minima under random linear maps."""
    if not len(hashes):
        return []
    least = least_of(hashes, _MULTIPLY, _ADD)
    return [int.from_bytes(hashlib.blake2b(least[b * ROWS : (b + 1) * ROWS].tobytes() + bytes([b]), digest_size=8).digest(), "little", signed=True) for b in range(BANDS)]


def comment_text(line: str) -> str:
    return re.sub(r"^[\s/#*!;<-]*(?=[\w@<])|[\s*/>-]+$", "", line) if "<auto" not in line.lower() else line[line.lower().index("<auto") :]


def judged(path: str, body: str) -> dict:
    """What a file shows by itself."""
    path = normal_path(path)
    tokens, head, literal, code = masked(path, body)
    top = "\n".join(head)
    lock = bool(LOCKS.search(path)) or path.lower().endswith((".json", ".lock")) and bool(LOCK_BODY.search(body))
    banner = bool(TOOL_PATH.search(path)) or any(BANNER.match(comment_text(line)) for line in head)
    upstream = bool(UPSTREAM.search(top)) and not OWN.search(top)
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    dense = False
    if longest >= LONG_LINE:
        notes = lexer_of(path)
        bare = "".join(m[0] if kind_of(m) not in ("note", "doc") else "" for m in notes.finditer(body))
        without = re.sub(r"(?m)^\s*(?://|#|--).*$", "", body)
        long_ = max(without.split("\n"), key=len) if without else ""
        dense = len(long_) >= LONG_LINE and sum(c.isspace() for c in long_) < DENSE * len(long_) and len(bare) > 0.5 * len(without.strip() or "x")
    shapes = Counter(re.sub(r"\d+", "0", re.sub(r"[^\W\d_]\w*|'[^']*'|\"[^\"]*\"", "a", x)) for x in lines if not re.match(r"(?://|#|--|/\*|\*)", x))
    total = sum(shapes.values())
    repeated = total >= REPEATED_LINES and max(n for s, n in shapes.items()) >= REPEATED_LINE_SHARE * total and any(n >= REPEATED_LINE_SHARE * total and len(s) > 6 for s, n in shapes.items())
    data = code >= 60 and literal >= LITERAL_SHARE * code
    hashes = shingles(tokens)
    return {"banner": banner, "upstream": upstream, "lock": lock, "dense": dense, "data": data or repeated, "hashes": hashes}


FILE = "asset_id string, repo string, banner boolean, upstream boolean, foreign boolean, alone boolean, set_id string, hashes array<long>, bands array<long>"
EVIDENCE = f"{FILE}, copied boolean, text_id string"


def file_evidence(files: DataFrame) -> DataFrame:
    """asset_id, repo, the file's own marks, its shingles with their bands, and whether it is a recorded copy; files without text keep their path's marks."""
    copied = F.col("copy_of").isNotNull() if "copy_of" in files.columns else F.lit(False)
    files = files.select("asset_id", "root_id", "path", "body", copied.alias("copied"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for asset, root, path, body, copied in zip(batch["asset_id"], batch["root_id"], batch["path"], batch["body"], batch["copied"], strict=True):
                at = normal_path(path)
                seen = judged(at, body or "")
                hashes = seen["hashes"]
                foreign = bool(FOREIGN_DIRS.search(at))
                alone = seen["lock"] or seen["dense"] or seen["data"]
                set_id = hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest() if len(hashes) else None
                text_id = hashlib.blake2b((body or "").encode("utf-8", "replace"), digest_size=16).hexdigest()
                rows.append((asset, f"{root}/{at.partition('/')[0]}", seen["banner"], seen["upstream"], foreign, alone, set_id, hashes.view(np.int64), bands(hashes), copied, text_id))
            yield pd.DataFrame(rows, columns=["asset_id", "repo", "banner", "upstream", "foreign", "alone", "set_id", "hashes", "bands", "copied", "text_id"])

    return files.mapInPandas(look, EVIDENCE)


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """asset_id, root_id, path, copy_of and whole text (null without chunks) of each code file, as delivered last.

    Where an asset has no path of its own, that of its symbols stands in.
    """
    assets = table(spark, folder, "source_assets").where((F.col("file_kind") == "code") & F.col("id").isNotNull())
    code = latest(assets.select(F.col("id").alias("asset_id"), "updated_at", "root_id", "path", F.col("canonical_asset_id").alias("copy_of")), "asset_id", "updated_at")
    symbols = table(spark, folder, "code_symbols").where(F.col("source_asset_id").isNotNull()).groupBy(F.col("source_asset_id").alias("asset_id")).agg(F.max("path").alias("symbol_path"))
    code = code.join(symbols, "asset_id", "left").select("asset_id", "root_id", F.coalesce("path", "symbol_path").alias("path"), "copy_of")
    chunks = table(spark, folder, "asset_chunks").where(F.col("asset_id").isNotNull() & F.col("body").isNotNull()).select("asset_id", "chunk_index", "updated_at", "body")
    own = chunks.join(small(assets.select(F.col("id").alias("asset_id")).distinct()), "asset_id", "left_semi")
    once = latest(own, ["asset_id", "chunk_index"], "updated_at")
    whole = once.groupBy("asset_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))), lambda x: x["body"]), "").alias("body"))
    return code.join(whole, "asset_id", "left")


def frequencies(sets: DataFrame) -> bytes:
    """Bits of the count of the shingles in each of ``SLOTS`` slots; of fixed size, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for hashes in batch["hashes"]:
                np.add.at(seen, np.asarray(hashes, dtype=np.int64) & (SLOTS - 1), 1)
        at = np.nonzero(seen)[0]
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": seen[at]})

    often = sets.select("hashes").mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").select("slot", F.ceil(F.log2("n")).cast("byte").alias("bits")).toPandas()
    bits = np.zeros(SLOTS, dtype=np.uint8)
    bits[often["slot"].to_numpy()] = often["bits"].to_numpy()
    return bits.tobytes()


def prefixes(sets: DataFrame, bits: bytes) -> DataFrame:
    """n, size and one row per shingle, with its place, among the rarest of each set, so many that sets alike to ``SIMILARITY`` share one."""
    shared = sets.sparkSession.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            found = []
            for hashes in batch["hashes"]:
                h = np.asarray(hashes, dtype=np.int64)
                least = -(-len(h) * SIMILAR_PERCENT // 100)  # a set alike to this one shares at least so many
                found.append(h[np.lexsort((h, rank[h & (SLOTS - 1)]))][: len(h) - least + 1])
            yield pd.DataFrame({"n": batch["n"], "size": batch["hashes"].map(len), "rare": found})

    made = sets.select("n", "hashes").mapInPandas(cut, "n long, size int, rare array<long>")
    return made.select("n", "size", F.posexplode("rare").alias("place", "shingle"))


def sketched(sets: DataFrame) -> DataFrame:
    """n and sketch of every set."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": batch["n"], "sketch": [sketch(np.asarray(h, dtype=np.int64).view(np.uint64)) for h in batch["hashes"]]})

    return sets.select("n", "hashes").mapInPandas(draw, "n long, sketch array<long>")


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches agree in ``AGREE`` bits; only the few left are worth the transport of their sets."""
    left = sketches.select(F.col("n").alias("a"), F.col("sketch").alias("ka"))
    right = sketches.select(F.col("n").alias("b"), F.col("sketch").alias("kb"))
    apart = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(left, "a").join(right, "b").where(apart <= SKETCH - AGREE).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a < b) whose sets agree to ``SIMILARITY``."""
    left = sets.select(F.col("n").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("n").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    return pairs.join(left, "a").join(right, "b").where(shared * 100 >= SIMILAR_PERCENT * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def links(sets: DataFrame) -> DataFrame:
    """n and component of the sets that are alike to ``SIMILARITY`` to another one, over all such pairs.

    The leaders of the MinHash buckets gather near copies first, one comparison per member.
    What they leave apart is joined exactly: two sets alike share a shingle among the rarest of
    both, so sets of different components that do are compared, and those of one component need
    not be. The last of the rare shingles they share bounds what they can have in common; pairs
    below the threshold by that bound, or by their sketches, are not compared.
    """
    sketches = cut_lineage(sketched(sets))
    placed = sets.select("n", F.posexplode("bands").alias("band", "bucket"))
    leader = placed.groupBy("band", "bucket").agg(F.min(F.struct(F.xxhash64("n", "band").alias("h"), "n")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "bucket", F.col("m.n").alias("leader"))
    led = placed.join(leader, ["band", "bucket"]).where("n <> leader").select(F.least("n", "leader").alias("a"), F.greatest("n", "leader").alias("b")).distinct()
    near = cut_lineage(verified(promising(led, sketches), sets))
    first = connected_components(near).select(F.col("node").alias("n"), "component")
    rare = cut_lineage(prefixes(sets, frequencies(sets)).join(first, "n", "left").withColumn("component", F.coalesce("component", "n")))
    several = rare.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle")
    rare = rare.join(several, "shingle", "left_semi")
    one, two = (rare.select("shingle", F.col("n").alias(n), F.col("size").alias(f"s{n}"), F.col("place").alias(f"p{n}"), F.col("component").alias(f"c{n}")) for n in "ab")
    sized = F.least("sa", "sb") * 100 >= F.greatest("sa", "sb") * SIMILAR_PERCENT
    met = one.join(two, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized)
    met = met.groupBy("a", "b").agg(F.max("sa").alias("sa"), F.max("sb").alias("sb"), F.count(F.lit(1)).alias("k"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    most = F.col("k") + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) - 1
    apart = met.where(most * (100 + SIMILAR_PERCENT) >= SIMILAR_PERCENT * (F.col("sa") + F.col("sb"))).select("a", "b")
    more = cut_lineage(verified(promising(apart, sketches), sets))
    if more.isEmpty():
        return first
    return connected_components(near.unionByName(more)).select(F.col("node").alias("n"), "component")


def clusters(files: DataFrame) -> DataFrame:
    """set_id, what its component of verified links shows (family, spread, blob) and the shares of its files' marks.

    Equal sets are counted first, so that a file copied any number of times is one row here.
    """
    own = ~F.col("copied") if "copied" in files.columns else F.lit(True)
    text = F.col("text_id") if "text_id" in files.columns else F.lit(None).cast("string")
    n = F.count(F.lit(1))
    sums = {"files": n, "banners": F.count_if("banner"), "upstreams": F.count_if(F.col("upstream") | F.col("foreign")), "literals": F.count_if("alone"), "own": F.count_if(own)}
    # least and greatest suffice to tell one from several
    bounds = {"text": F.when(own, text), "home": F.when(own, F.col("repo")), "repo": F.col("repo")}
    ends = [e for k, c in bounds.items() for e in (F.min(c).alias(f"{k}_a"), F.max(c).alias(f"{k}_z"))]
    sets = files.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(*[c.alias(k) for k, c in sums.items()], *ends, F.first("hashes").alias("hashes"), F.first("bands").alias("bands"))
    sets = cut_lineage(sets.withColumn("n", F.monotonically_increasing_id()))
    values = [*sums, *(f"{k}_{e}" for k in bounds for e in "az")]
    member = cut_lineage(sets.select("set_id", "n", *values).join(links(sets), "n", "left").withColumn("component", F.coalesce("component", "n")))
    whole = member.groupBy("component").agg(*[F.sum(v).alias(v) for v in sums], *[e for k in bounds for e in (F.min(f"{k}_a").alias(f"{k}_a"), F.max(f"{k}_z").alias(f"{k}_z"))])
    related = F.col("own") >= RELATIVES
    told = whole.select(
        "component",
        F.coalesce(related & (F.col("text_a") != F.col("text_z")), F.lit(False)).alias("family"),
        F.coalesce(related & (F.col("text_a") == F.col("text_z")) & (F.col("home_a") != F.col("home_z")), F.lit(False)).alias("spread"),
        (related & (F.col("literals") == F.col("files"))).alias("blob"),
        (F.col("banners") / F.col("files")).alias("banner_share"),
        F.when(F.col("repo_a") != F.col("repo_z"), F.col("upstreams") / F.col("files")).otherwise(0.0).alias("upstream_share"),
    )
    return member.select("set_id", "component").join(told, "component").drop("component")


def foreign_files(files: DataFrame) -> DataFrame:
    """asset_id and the reasons (generated, vendored, data) of the files not written by hand in their project.

    Files without text are judged by their path; without text, path and relatives a file counts
    as written by hand. Repeated rows of an asset count once.
    """
    seen = cut_lineage(file_evidence(files))
    related = clusters(seen)
    whole = seen.select("asset_id", "set_id", "banner", "upstream", "foreign", "alone").join(related, "set_id", "left").na.fill(False, ["family", "spread", "blob"])
    generated = F.col("family") & ~F.col("blob") | F.col("banner") | (F.coalesce("banner_share", F.lit(0.0)) >= BANNER_SHARE)
    vendored = F.col("spread") | F.col("upstream") | F.col("foreign") | (F.coalesce("upstream_share", F.lit(0.0)) >= UPSTREAM_SHARE)
    return whole.select("asset_id", generated.alias("generated"), vendored.alias("vendored"), (F.col("blob") | F.col("alone")).alias("data")).where("generated or vendored or data").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return foreign_files(code_files(spark, folder)).select("asset_id").distinct()


def p6_hand_written(spark: SparkSession, folder: str) -> DataFrame:
    """The code files that remain."""
    files = code_files(spark, folder)
    return files.select("asset_id", "path").join(foreign_files(files).select("asset_id"), "asset_id", "left_anti")


QUERIES = {"p6_found": p6_found, "p6_hand_written": p6_hand_written}
SQL: dict[str, str] = {}
