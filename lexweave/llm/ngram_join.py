"""N-gram Jaccard join with a token-group matrix.

Two documents link when their sets of word shingles have Jaccard similarity of at least
``THRESHOLD`` percent. The join is exact:

1. Documents with equal sets are one *class*, named by a hash of the set. Classes send their
   shingles, as 48-bit tokens in packed arrays, to owners of token ranges; an owner finds how
   many classes hold each token. Only tokens of two classes or more go on, and only classes
   with at least ``THRESHOLD`` percent such tokens: no other class can link with anything.
2. Tokens are ordered by how many classes hold them. A class looks for partners by the prefix
   of its tokens in that order which every partner must touch (prefix filter).
3. *Groups.* Each class is compared with the plainest class (fewest tokens of its own) that
   some of its prefix tokens lead to; where they link, it joins that leader's group. A group is
   therefore connected, and nothing inside it is compared again. Large groups are dealt into
   chunks of at most ``CHUNK`` members.
4. *Token-group matrix.* For each chunk the union of its members' tokens is stored. A class asks
   a chunk of another group only if a prefix token leads there and sizes allow. Its overlap with
   the union bounds that with any member; only chunks whose bound is met open, and only then do
   members' tokens move. Inside, overlaps with all members come from one product of incidence
   matrices.
5. Links of both kinds give the components.

A group of copies is one class. A group of near copies is one or few groups, at a cost in
proportion to its members, and not to their pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import give_back, given_back, settle, shuffle_partitions, small, stored, whole_text
from lexweave.llm.components import components

WORDS = 5
THRESHOLD = 80  # percent
TOKEN_BITS = 48
FLUSH = 1_000_000  # tokens that a task holds before it deals them out
OWNER_TOKENS = 2_000_000  # tokens that an owner of a token range gets on average, at most
CHUNK = 128  # members of a chunk of a group
VISITORS = 512  # classes that are compared with a chunk at once

_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text: bytes, words: int = WORDS):
    """Sorted distinct tokens of a UTF-8 text: A-Z lower-cased, words at ASCII white space."""
    import numpy as np
    import xxhash

    w = text.translate(_lower).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, w)), dtype=np.uint64)
    n = len(h) - words + 1
    if n < 1:
        h, n = np.array([xxhash.xxh64_intdigest(b" ".join(w))], dtype=np.uint64), 1
        s = h
    else:
        s = h[:n].copy()
        for k in range(1, words):
            s *= np.uint64(0x9E3779B97F4A7C15)
            s ^= s >> np.uint64(32)
            s += h[k : k + n]
    s *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s >> np.uint64(64 - TOKEN_BITS))


def class_of(tokens) -> int:
    """The class of a set: a signed 64-bit hash."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return h - (1 << 64) if h >> 63 else h


def classes_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and class of each document; the class of an empty set is null."""

    def sets(batches):
        import pyarrow as pa

        from lexweave.llm.tokens import text_slices

        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                found = [shingle_set(t, words) for t in texts]
                yield pa.record_batch(
                    [batch.column(0).slice(first, len(texts)), pa.array([len(s) for s in found], pa.int64()), pa.array([class_of(s) if len(s) else None for s in found], pa.int64())],
                    names=["doc_id", "n_shingles", "class"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), whole_text().alias("text")).mapInArrow(lambda b: given_back(sets(b)), "doc_id bigint, n_shingles bigint, class bigint")


def class_column(words: int):
    """A function of text columns: the class of each text, null without words."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("bigint")
    def name(texts):
        import pandas as pd

        found = (shingle_set(t.encode(), words) for t in texts)
        return pd.Series([class_of(s) if len(s) else None for s in found], dtype="Int64")

    return name


def _packed(tokens) -> bytes:
    import numpy as np

    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].tobytes()


def _unpacked(raw: bytes):
    import numpy as np

    width = TOKEN_BITS // 8
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _deal(sets, owners: int):
    """Record batches (owner, class, runs, tokens) of (class, tokens) pairs; a class that comes again is left out."""
    import numpy as np
    import pyarrow as pa

    seen, held, size = set(), [], 0

    def flush():
        tok = np.concatenate([s for _, s in held])
        doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(s) for _, s in held])
        name = np.array([c for c, _ in held], np.int64)
        owner = (tok % np.uint64(owners)).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        tok, doc, owner = tok[order], doc[order], owner[order]
        at = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for a, b in zip(at.tolist(), at[1:].tolist() + [len(owner)]):
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
            runs = np.diff(np.append(first, b - a))
            rows.append((int(owner[a]), name[doc[a:b][first]].tobytes(), runs.astype("<u4").tobytes(), _packed(tok[a:b])))
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["owner", "class", "runs", "tokens"])

    for c, s in sets:
        if c not in seen:
            seen.add(c)
            held.append((c, s))
            size += len(s)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


DEALT = "owner int, class binary, runs binary, tokens binary"


def shared_tokens(docs: DataFrame, words: int, owners: int) -> DataFrame:
    """(part, class, runs, tokens, holders): tokens that several classes hold, packed by owner and part of the classes."""

    def deal(batches):
        from lexweave.llm.tokens import text_slices

        def sets():
            for batch in batches:
                for _, texts in text_slices(batch.column(0)):
                    for t in texts:
                        s = shingle_set(t, words)
                        if len(s):
                            yield class_of(s), s

        return _deal(sets(), owners)

    def count(table):
        import numpy as np
        import pyarrow as pa

        names = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column("class")])
        runs = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("runs")])
        tok = np.concatenate([_unpacked(x.as_py()) for x in table.column("tokens")])
        who = np.repeat(np.arange(len(names), dtype=np.int32), runs)
        order = np.argsort(tok)
        tok, who = tok[order], who[order]
        same = tok[1:] == tok[:-1]
        often = np.zeros(len(tok), bool)
        often[1:] |= same
        often[:-1] |= same
        tok, name = tok[often], names[who[often]]
        order = np.lexsort((name, tok))
        tok, name = tok[order], name[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (name[1:] != name[:-1])  # several tasks can meet one class
        tok, name = tok[new], name[new]
        _, holders = np.unique(tok, return_counts=True)
        holders = np.repeat(holders, holders)
        more = holders > 1
        tok, name, holders = tok[more], name[more], np.minimum(holders[more], 65535).astype("<u2")
        part = name % owners
        order = np.lexsort((name, part))
        tok, name, holders, part = tok[order], name[order], holders[order], part[order]
        rows = []
        at = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for a, b in zip(at, at[1:] + [len(part)]):
            first = np.flatnonzero(np.diff(name[a:b], prepend=name[a] + 1))
            runs = np.diff(np.append(first, b - a)).astype("<u4")
            rows.append((int(part[a]), name[a:b][first].tobytes(), runs.tobytes(), _packed(tok[a:b]), holders[a:b].tobytes()))
        cols = list(zip(*rows)) or [()] * 5
        give_back()
        return pa.table({"part": pa.array(cols[0], pa.int64())} | {k: pa.array(c, pa.binary()) for k, c in zip(("class", "runs", "tokens", "holders"), cols[1:])})

    dealt = docs.select(whole_text().alias("text")).mapInArrow(lambda b: given_back(deal(b)), DEALT)
    return dealt.groupBy("owner").applyInArrow(count, "part bigint, class binary, runs binary, tokens binary, holders binary")


def able_classes(docs: DataFrame, found: DataFrame, words: int = WORDS) -> DataFrame:
    """Classes that can have a partner: class, n, shared, tokens (sorted, packed), prefix.

    ``found``: the result of :func:`classes_of`.
    """
    total = found.agg(F.sum("n_shingles")).first()[0] or 0
    owners = max(shuffle_partitions(docs.sparkSession), -(-total // OWNER_TOKENS))
    parts = shared_tokens(docs, words, owners)
    sizes = found.where(F.col("class").isNotNull()).groupBy(F.col("class").alias("name")).agg(F.max("n_shingles").alias("n"))
    sizes = sizes.withColumn("home", F.pmod("name", F.lit(owners).cast("bigint")))

    def gather(parts, sizes):
        import numpy as np
        import pyarrow as pa

        out = {k: [] for k in ("class", "n", "shared", "tokens", "prefix")}
        if parts.num_rows and sizes.num_rows:
            join = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in parts.column(c)), kind)
            name = np.repeat(join("class", "<i8"), join("runs", "<u4"))
            tok, holders = _unpacked(join("tokens", np.uint8).tobytes()), join("holders", "<u2")
            order = np.argsort(name, kind="stable")
            name, tok, holders = name[order], tok[order], holders[order]
            at = np.flatnonzero(np.diff(name, prepend=name[0] + 1))
            shared = np.diff(np.append(at, len(name)))
            known, n = sizes.column("name").to_numpy(), sizes.column("n").to_numpy()
            order = np.argsort(known)
            n = n[order][np.searchsorted(known[order], name[at])]
            for i in np.flatnonzero(shared * 100 >= n * THRESHOLD).tolist():
                a, b, size = int(at[i]), int(at[i] + shared[i]), int(n[i])
                least = -(-size * THRESHOLD // 100)
                first = np.lexsort((tok[a:b], holders[a:b]))[: b - a - least + 1]  # tokens of its own come before all these
                for k, v in zip(out, (int(name[a]), size, b - a, _packed(np.sort(tok[a:b])), tok[a:b][first].astype(np.int64).tolist())):
                    out[k].append(v)
        give_back()
        return pa.table(
            {k: pa.array(out[k], pa.int64()) for k in ("class", "n", "shared")}
            | {"tokens": pa.array(out["tokens"], pa.binary()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64()))}
        )

    return parts.groupBy("part").cogroup(sizes.groupBy("home")).applyInArrow(gather, "class bigint, n bigint, shared bigint, tokens binary, prefix array<bigint>")


def _can_link(n, shared, other_n, other_shared):
    """Whether a link is possible: at Jaccard t, t (|A| + |B|) / (1 + t) tokens are common, and tokens of one's own aren't."""
    together = F.col(n) + F.col(other_n)
    return F.least(F.col(shared), F.col(other_shared)) * (100 + THRESHOLD) >= together * THRESHOLD


def led_links(able: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(a, leader): verified links of classes with the plainest class that their prefix tokens lead to."""
    plain = F.struct((1 - F.col("shared") / F.col("n")).alias("share"), F.col("class"), F.col("n"), F.col("shared"))
    lead = prefixes.groupBy("token").agg(F.min(plain).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    lead = lead.select("token", F.col("lead.class").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.shared").alias("leader_shared"), F.col("lead.share").alias("share"))
    votes = (
        prefixes.join(lead, "token").where((F.col("class") != F.col("leader")) & _can_link("n", "shared", "leader_n", "leader_shared"))
        .groupBy("class", "leader").agg(F.min("share").alias("share"), F.count(F.lit(1)).alias("votes"))
    )
    # one leader for each class; what else there is the matrix finds
    pairs = votes.groupBy("class").agg(F.min(F.struct("share", -F.col("votes"), "leader")).alias("best")).select("class", F.col("best.leader").alias("leader"))
    pairs = stored(pairs, "jaccard_pairs")
    rooms = stored(pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("rooms")), "jaccard_rooms")
    led = able.select(F.col("class").alias("leader"), F.col("n").alias("h_n"), F.col("tokens").alias("h_tokens")).join(small(rooms), "leader")
    led = led.select(F.col("leader").alias("h_class"), "h_n", "h_tokens", F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("h_room"))
    seated = pairs.join(rooms, "leader").select("leader", F.pmod(F.xxhash64("class"), F.col("rooms")).cast("int").alias("room"), F.col("class").alias("v_class"))
    packs = able.select(F.col("class").alias("v_class"), F.col("n").alias("v_n"), F.col("tokens").alias("v_tokens"))
    followers = packs.join(small(stored(seated, "jaccard_seated")), "v_class").select("leader", "room", "v_class", "v_n", "v_tokens")

    def verify(guests, host):
        import numpy as np
        import pyarrow as pa

        a, b = [], []
        if guests.num_rows and host.num_rows:
            name, size, own = host.column("h_class")[0].as_py(), host.column("h_n")[0].as_py(), _unpacked(host.column("h_tokens")[0].as_py())
            for guest, n, t in zip(guests.column("v_class").to_pylist(), guests.column("v_n").to_pylist(), guests.column("v_tokens")):
                common = len(np.intersect1d(own, _unpacked(t.as_py()), assume_unique=True))
                if common * 100 >= THRESHOLD * (n + size - common):
                    a.append(guest)
                    b.append(name)
        return pa.table({"a": pa.array(a, pa.int64()), "leader": pa.array(b, pa.int64())})

    return followers.groupBy("leader", "room").cogroup(led.groupBy("h_class", "h_room")).applyInArrow(verify, "a bigint, leader bigint")


def visiting_links(able: DataFrame, prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): links between classes of different groups, found through the token-group matrix.

    ``groups``: class, grp, of all classes of ``able``.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    seats = groups.join(sizes, "grp").select(
        "class", "grp", "members", F.pmod(F.xxhash64("class"), F.ceil(F.col("members") / CHUNK).cast("bigint")).alias("chunk")
    )
    seats = stored(seats, "group_seats")
    held = prefixes.join(seats, "class")
    matrix = held.groupBy("token", "grp", "chunk", "members").agg(F.min("n").alias("least"), F.max("shared").alias("most_shared"))
    asks = held.select("token", F.col("class").alias("visitor"), F.col("n").alias("visitor_n"), F.col("shared").alias("visitor_shared"), F.col("grp").alias("from_grp"), F.col("members").alias("from_members"))
    # of two groups, the one with fewer members visits
    smaller = (F.col("from_members") < F.col("members")) | ((F.col("from_members") == F.col("members")) & (F.col("from_grp") < F.col("grp")))
    fits = _can_link("visitor_n", "visitor_shared", "least", "most_shared")
    visits = (
        asks.join(matrix, "token").where((F.col("from_grp") != F.col("grp")) & smaller & fits)
        .select("visitor", "grp", "chunk").distinct()
    )
    visits = stored(visits, "group_visits")
    home, packs = ["grp", "chunk"], able.select("class", "n", "tokens")
    visited = stored(seats.join(visits.select(*home).distinct(), home, "left_semi").select("class", *home), "group_visited")
    seated = packs.join(small(visited), "class").select("grp", "chunk", "class", "n", "tokens")
    unions = stored(seated.groupBy(*home).applyInArrow(_union, "grp bigint, chunk bigint, members bigint, member bigint, least bigint, tokens binary"), "group_unions")

    def guests(visits, rooms):
        room = F.pmod(F.xxhash64("visitor"), F.col("rooms")).cast("int").alias("room")
        placed = stored(visits.join(rooms, home).select("visitor", *home, room), "group_placed")
        named = packs.select(F.col("class").alias("visitor"), "n", "tokens")
        return named.join(small(placed), "visitor").select("grp", "chunk", "room", F.col("visitor").alias("v_class"), F.col("n").alias("v_n"), F.col("tokens").alias("v_tokens"))

    def hosts(table, rooms):
        every = F.explode(F.sequence(F.lit(0), F.col("rooms") - 1)).alias("h_room")
        others = [F.col(c).alias(f"h_{c}") for c in table.columns if c not in home]
        return table.join(small(rooms), home).select(F.col("grp").alias("h_grp"), F.col("chunk").alias("h_chunk"), every, *others)

    def met(visits, table, work, schema):
        rooms = stored(visits.groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("rooms")), "group_rooms")
        came = guests(visits, rooms).groupBy("grp", "chunk", "room")
        return came.cogroup(hosts(table, rooms).groupBy("h_grp", "h_chunk", "h_room")).applyInArrow(work, schema)

    # the union of one member is the member, so its bound is the answer; other chunks open if theirs is met
    qualified = stored(met(visits, unions, _within_bound, "visitor bigint, grp bigint, chunk bigint, member bigint"), "group_qualified")
    opened = qualified.where("member IS NULL").select("visitor", *home)
    links = met(opened, seated, _open_chunk, "a bigint, b bigint")
    return links.unionByName(qualified.where("member IS NOT NULL").select(F.col("visitor").alias("a"), F.col("member").alias("b")))


def _union(members):
    """The tokens of a chunk's members, each once, and the size of the smallest; ``member`` is the only one, or null."""
    import numpy as np
    import pyarrow as pa

    union = np.unique(np.concatenate([_unpacked(t.as_py()) for t in members.column("tokens")]))
    one = members.num_rows == 1
    return pa.table(
        {
            "grp": members.column("grp").slice(0, 1), "chunk": members.column("chunk").slice(0, 1), "members": pa.array([members.num_rows], pa.int64()),
            "member": pa.array([members.column("class")[0].as_py() if one else None], pa.int64()),
            "least": pa.array([min(members.column("n").to_pylist())], pa.int64()), "tokens": pa.array([_packed(union)], pa.binary()),
        }
    )


def _within_bound(guests, host):
    """Guests that could link with a member, as none shares more with them than the union or is smaller than the least."""
    import numpy as np
    import pyarrow as pa

    keep, member = [], None
    if guests.num_rows and host.num_rows:
        union, least, member = _unpacked(host.column("h_tokens")[0].as_py()), host.column("h_least")[0].as_py(), host.column("h_member")[0].as_py()
        for n, t in zip(guests.column("v_n").to_pylist(), guests.column("v_tokens")):
            t = _unpacked(t.as_py())
            at = np.minimum(np.searchsorted(union, t), len(union) - 1)
            common = int((union[at] == t).sum())
            keep.append(common * 100 >= THRESHOLD * (n + least - min(common, least)))
    out = guests.filter(pa.array(keep, pa.bool_())) if keep else guests.slice(0, 0)
    return pa.table({"visitor": out.column("v_class"), "grp": out.column("grp"), "chunk": out.column("chunk"), "member": pa.array([member] * out.num_rows, pa.int64())})


def _open_chunk(guests, members):
    """(a, b): links of guests with members of a chunk."""
    import numpy as np
    import pyarrow as pa

    a, b = [], []
    if guests.num_rows and members.num_rows:
        own = [_unpacked(t.as_py()) for t in members.column("h_tokens")]
        own_n, own_name = np.array(members.column("h_n").to_pylist()), members.column("h_class").to_pylist()
        asking = [_unpacked(t.as_py()) for t in guests.column("v_tokens")]
        names, sizes = guests.column("v_class").to_pylist(), guests.column("v_n").to_pylist()
        used = np.unique(np.concatenate(asking))  # only columns that some guest has count
        seats = [np.searchsorted(used, t) for t in asking]
        for lo in range(0, len(own), 32):
            rows = np.zeros((min(32, len(own) - lo), len(used)), np.float32)
            for i, t in enumerate(own[lo : lo + 32]):
                at = np.minimum(np.searchsorted(used, t), len(used) - 1)
                rows[i, at[used[at] == t]] = 1
            for name, n, at in zip(names, sizes, seats):
                common = rows[:, at].sum(axis=1).astype(np.int64)
                for i in np.flatnonzero(common * 100 >= THRESHOLD * (n + own_n[lo : lo + 32] - common)).tolist():
                    a.append(name)
                    b.append(own_name[lo + i])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _grouped(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(found, groups): the classes of all documents, and of each class its component's first document and number of rows."""
    docs = docs.select("doc_id", "text")
    found = stored(classes_of(docs, words), "jaccard_classes")
    able = stored(able_classes(docs, found, words), "jaccard_able")
    prefixes = stored(able.select("class", "n", "shared", F.explode("prefix").alias("token")), "jaccard_prefixes")
    led = stored(led_links(able, prefixes), "jaccard_led")
    chosen = led.select(F.col("a").alias("class"), "leader")
    # a leader stays with its own group, wherever it is led itself
    leads = chosen.select(F.col("leader").alias("class")).distinct().withColumn("leads", F.lit(True))
    groups = able.select("class").join(chosen, "class", "left").join(leads, "class", "left")
    groups = stored(groups.select("class", F.when(F.col("leads"), F.col("class")).otherwise(F.coalesce("leader", "class")).alias("grp")), "jaccard_groups")
    between = visiting_links(able, prefixes, groups)
    links = stored(led.select("a", F.col("leader").alias("b")).unionByName(between), "jaccard_links")
    linked = components(links)
    by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")  # null ids last
    names = found.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(by_id).alias("first"), F.count(F.lit(1)).alias("docs"))
    joined = names.join(linked, names["class"] == linked["node"], "left").select("class", "first", "docs", "component")
    joined = stored(joined, "jaccard_names")
    least = joined.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("least"), F.sum("docs").alias("members"))
    groups = joined.join(least, "component", "left").select("class", F.coalesce("least", "first").alias("first"), F.coalesce("members", "docs").alias("members"))
    return found, groups


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, a document's own included.

    Texts without words (null, empty) have no shingle and link with nothing, not even with each
    other; texts with fewer than ``words`` words are one shingle. Rows that repeat a doc_id are
    documents of their own with that id; a null doc_id never names a component unless it is
    alone in it. An empty table gives an empty result; other columns are ignored.

    Sets hold 48-bit hashes of shingles and classes 64-bit hashes of sets; neither is checked
    against the words.
    """
    found, groups = _grouped(docs, words)
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return found.join(groups, "class", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id (null last), with all its columns.

    A row is known by doc_id and its set of shingles, so a dropped row goes even if another row
    with its id stays. Of rows that tie for one place the smallest set hash, then the least row
    by its columns, in their order, stays. Documents without words all stay.
    """
    found, groups = _grouped(docs, words)
    members = found.join(groups.where("members > 1"), "class").groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("rows"), F.first("first").alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("class") == F.col("first.class"))
    decided = members.withColumn("kept", kept).where("NOT kept OR rows > 1").select("doc_id", "class", "kept")
    return settle(docs, stored(decided, "jaccard_decided"), {"class": class_column(words)(whole_text())})
