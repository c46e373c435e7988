"""Outpoint matching and unspent outputs.

Rule (the reference folds all rows sharing an outpoint): an outpoint is
*unspent* iff exactly one element row carries it and that row is an output
(type 1). Two rows of any types mark it matched (state 2) — duplicate
outputs annihilate each other — and a lone input stays type 0 and is
dropped. This is an aggregation, not an anti-join.

Plan shape: the fold is a ``groupBy(tx_hash, idx)`` over numeric columns
only, which keeps Spark's HashAggregate with a map-side partial step — a
hot outpoint (e.g. every coinbase input sharing a null outpoint) collapses
to one row per map task before the shuffle. Wide payloads (block hash,
script) are never carried through that shuffle:

* full sets join the surviving keys back to the outputs (shuffle join on
  the same key, so AQE can split a skewed side); a Bloom filter of the
  surviving keys drops spent outputs before that shuffle, as far as its
  size stays in bound (``keyfilter``);
* addresses need only 20 bytes, which ride through the fold as three
  integers and are rebuilt on the survivors;
* top-k results take k numeric rows first. Over a stored table these carry
  their row's address and only the winners' files are read again
  (``rowaddress``); otherwise the payload comes through a broadcast join
  whose size is bounded by k (checked against ``MAX_BROADCAST_ROWS``; above
  it the join is left to the planner).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import script_hash160_hex, with_address, with_hash160_address
from ..functions.encoding import hex_lower
from . import keyfilter, rowaddress

KEY = ["tx_hash", "idx"]

# A top-k side is broadcast only while k is at most this many rows (a key
# row is ~100 bytes, so ~25 MB); larger k falls back to a shuffle join.
MAX_BROADCAST_ROWS = 250_000

# Rows of a stored table that one task folds at most (about 250 bytes each in
# its map); a split of more rows is folded in shares of its outpoints.
FOLD_ROWS = 2_000_000


def _join_bounded(big: DataFrame, small: DataFrame, on, bound_rows: int,
                  how: str = "inner") -> DataFrame:
    """Join ``small`` (at most ``bound_rows`` rows by construction) to ``big``.

    Broadcast when the bound is small enough; otherwise let Catalyst/AQE
    pick a shuffle join.
    """
    if bound_rows <= MAX_BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, on=on, how=how)


def _keyed(df: DataFrame, compact: bool) -> tuple[DataFrame, list[str]]:
    """The outpoint key columns. With ``compact`` the hex transaction hash is
    grouped and joined as its binary form (32 instead of 64 bytes in a real
    chain); only valid when every ``tx_hash`` is canonical lower-case hex of
    even length, as decoded block files produce. The string column itself
    is always taken from the original rows, never rebuilt from the key."""
    if not compact:
        return df, KEY
    return df.withColumn("_k", F.unhex(F.col("tx_hash"))), ["_k", "idx"]


def outpoint_fold(elements: DataFrame, *numeric: str | Column,
                  compact_keys: bool = False) -> DataFrame:
    """``<key>, n, max_type[, numeric payload…]`` per outpoint (key =
    ``tx_hash, idx`` or ``_k, idx`` with compact keys).

    Payload columns are taken with ``max``, exact for single-row groups. Numeric
    ones keep the aggregate a HashAggregate; a text makes it a SortAggregate.
    """
    df, key = _keyed(elements, compact_keys)
    aggs = [F.count(F.lit(1)).alias("n"), F.max("type").alias("max_type")]
    for c in numeric:
        col = F.col(c) if isinstance(c, str) else c
        name = c if isinstance(c, str) else None
        aggs.append(F.max(col).alias(name) if name else F.max(col))
    return df.groupBy(*key).agg(*aggs)


def _tx_hash_of_key(compact: bool) -> Column:
    return F.lower(F.hex(F.col("_k"))).alias("tx_hash") if compact else F.col("tx_hash")


def outpoint_state(elements: DataFrame, compact_keys: bool = False) -> DataFrame:
    """``tx_hash, idx, state``: 1 unspent output, 0 lone input, 2 matched."""
    f = outpoint_fold(elements, compact_keys=compact_keys)
    return f.select(_tx_hash_of_key(compact_keys), "idx",
                    F.when(F.col("n") > 1, F.lit(2)).otherwise(F.col("max_type"))
                    .cast("int").alias("state"))


def outpoint_keys(elements: DataFrame, compact_keys: bool = False) -> DataFrame:
    """``outpoint, n``: display key ``tx_hash_idx`` and how many rows carry it."""
    f = outpoint_fold(elements, compact_keys=compact_keys)
    return f.select(F.concat_ws("_", _tx_hash_of_key(compact_keys),
                                F.col("idx").cast("string")).alias("outpoint"),
                    F.col("n"))


def _unspent_filter() -> Column:
    return (F.col("n") == 1) & (F.col("max_type") == 1)


def unspent_keys(elements: DataFrame, *numeric: str | Column,
                 compact_keys: bool = False) -> DataFrame:
    """Keys of unspent outputs, with optional numeric payload columns."""
    return (outpoint_fold(elements, *numeric, compact_keys=compact_keys)
            .where(_unspent_filter()).drop("n", "max_type"))


def _semi_unspent(outputs: DataFrame, elements: DataFrame, compact: bool) -> DataFrame:
    """``outputs`` rows whose outpoint is unspent in ``elements`` (shuffle semi-join)."""
    return semi_keys(outputs, unspent_keys(elements, compact_keys=compact), compact)


def semi_keys(outputs: DataFrame, keys: DataFrame, compact: bool = False) -> DataFrame:
    """``outputs`` rows whose outpoint is in ``keys``."""
    outs, key = _keyed(outputs, compact)
    return outs.join(keys, on=key, how="left_semi").select(*outputs.columns)


def _filtered_unspent(outputs: DataFrame, keys: DataFrame, compact: bool,
                      max_bytes: int = keyfilter.MAX_BYTES) -> DataFrame:
    """``outputs`` rows whose outpoint is in ``keys``, those without one dropped
    before the shuffle. The keys are written first: the filter, the join and a
    lost executor read them from there."""
    from ..session import materialize

    keys = materialize(outputs.sparkSession, keys, "unspent_keys")
    outs, key = _keyed(outputs, compact)
    held = keyfilter.build(keys, key, keys.count(), max_bytes=max_bytes)
    if held is not None:
        outputs = outs.where(held.test(*key)).select(*outputs.columns)
    return semi_keys(outputs, keys, compact)


def unspent_outputs(elements: DataFrame, compact_keys: bool = False,
                    strategy: str = "semi") -> DataFrame:
    """Every unspent output row with all its columns (``type`` is 1).

    ``strategy="semi"`` (default): numeric fold, then a shuffle semi-join of
    the outputs on the surviving keys — the payload moves once and never
    through an aggregate. ``"filter"``: the same, with the outputs sifted by a
    Bloom filter of the surviving keys first, so only about as many payloads
    move as survive; the fold runs when this is called and its keys are stored.
    ``"single_pass"``: one aggregate carrying every
    column (exact, since survivors are single-row groups); Spark plans it as
    a SortAggregate with a partial step. It reads the elements once, which
    pays off when they are expensive to produce; measured slower on Parquet.
    """
    outputs = elements.where(F.col("type") == 1)
    if strategy == "semi":
        return _semi_unspent(outputs, elements, compact_keys)
    if strategy == "filter":
        return _filtered_unspent(outputs, unspent_keys(elements, compact_keys=compact_keys), compact_keys)
    if strategy != "single_pass":
        raise ValueError(f"unknown strategy {strategy!r}")
    df, key = _keyed(elements, compact_keys)
    payload = [c for c in elements.columns if c not in KEY and c != "type"]
    if compact_keys:
        payload.append("tx_hash")
    folded = (df.groupBy(*key)
              .agg(F.count(F.lit(1)).alias("n"), F.max("type").alias("max_type"),
                   *[F.max(c).alias(c) for c in payload])
              .where(_unspent_filter()))
    return folded.select(F.col("max_type").alias("type"), *[
        F.col(c) for c in elements.columns if c != "type"])


def top_unspent(elements: DataFrame, k: int = 100, with_script: bool = False,
                compact_keys: bool = False) -> DataFrame:
    """The k largest unspent outputs (ties by outpoint).

    Without script: ``type, block_hash, tx_idx, tx_hash, idx, amount``.
    With script (no block id, as in the reference):
    ``type, tx_idx, tx_hash, idx, amount, script_hex``.

    Over a stored table the top-k runs when this is called, and the payload is
    read from the winners' files; over any other source nothing runs yet.
    """
    stored = rowaddress.with_address(elements) if k <= rowaddress.MAX_ROWS else None
    if stored is not None:
        return _top_by_address(elements, stored, k, with_script, compact_keys)
    _, key = _keyed(elements, compact_keys)
    top = (unspent_keys(elements, "amount", "tx_idx", compact_keys=compact_keys)
           .orderBy(F.col("amount").desc(), *key).limit(k))
    payload = ["script"] if with_script else ["block_hash"]
    outs, _ = _keyed(elements.where(F.col("type") == 1).select(*KEY, *payload), compact_keys)
    return _top_rows(_join_bounded(outs, top, key, k), with_script)


def _top_rows(j: DataFrame, with_script: bool) -> DataFrame:
    if with_script:
        res = j.select(F.lit(1).alias("type"), "tx_idx", "tx_hash", "idx", "amount",
                       hex_lower(F.col("script")).alias("script_hex"))
    else:
        res = j.select(F.lit(1).alias("type"), "block_hash", "tx_idx", "tx_hash", "idx", "amount")
    return res.orderBy(F.col("amount").desc(), "tx_hash", "idx")


def _in_shares(elements: DataFrame) -> DataFrame:
    """``elements``, with splits dealt to so many tasks that each folds about
    ``FOLD_ROWS`` rows. A split is bounded in bytes alone, and rows that pack well
    are many in it. All rows of an outpoint stay in one share, so that a hot one
    still collapses to a row per split."""
    per_task = elements.groupBy(F.spark_partition_id().alias("_task")).count()
    shares = -(-(per_task.agg(F.max("count")).first()[0] or 0) // FOLD_ROWS)
    if shares < 2:
        return elements
    own = F.pmod(F.xxhash64(*KEY), F.lit(shares))
    return reduce(DataFrame.unionAll, [elements.where(own == i) for i in range(shares)])


def _winners(elements: DataFrame, k: int, compact_keys: bool) -> list:
    """Address, key, amount and ``tx_idx`` of the k largest unspent outputs of
    elements with addresses."""
    elements = _in_shares(elements)
    _, key = _keyed(elements, compact_keys)
    top = (unspent_keys(elements, "amount", "tx_idx", *rowaddress.ADDRESS, compact_keys=compact_keys)
           .orderBy(F.col("amount").desc(), *key).limit(k))
    return top.select(F.col(key[0]).alias("_key"), F.col("idx").alias("_idx"), "amount", "tx_idx",
                      *rowaddress.ADDRESS).collect()                   # k rows


def _same_key(compact: bool) -> Column:
    mine = F.unhex("tx_hash") if compact else F.col("tx_hash")
    return mine.eqNullSafe(F.col("_key")) & F.col("idx").eqNullSafe(F.col("_idx"))


def _top_by_address(elements: DataFrame, stored: DataFrame, k: int, with_script: bool,
                    compact_keys: bool) -> DataFrame:
    """``top_unspent`` of a stored element table."""
    winners = _winners(stored, k, compact_keys)
    payload = "script" if with_script else "block_hash"
    if not winners:
        return _top_rows(elements.where(F.lit(False)), with_script)
    j = rowaddress.fetch(elements.where(F.col("type") == 1), winners, *KEY, payload)
    return _top_rows(j.where(_same_key(compact_keys)).withColumn("tx_idx", F.col("tx_idx").cast("int")),
                     with_script)


def top_unspent_nested(blocks: DataFrame, k: int = 100, with_script: bool = False) -> DataFrame:
    """``top_unspent`` of nested block records. Over a stored table the winners
    carry the address of their block's row, and ``tx_idx`` and ``idx`` say where
    in it they stand: only the files of those blocks are read again."""
    from .blocks import elements_from_blocks

    stored = rowaddress.with_address(blocks) if k <= rowaddress.MAX_ROWS else None
    if stored is None:
        return top_unspent(elements_from_blocks(blocks), k, with_script, compact_keys=True)
    winners = _winners(elements_from_blocks(stored, *rowaddress.ADDRESS), k, True)
    if not winners:
        return _top_rows(elements_from_blocks(blocks).where(F.lit(False)), with_script)
    rows = rowaddress.fetch(blocks, winners, "block_hash", "transactions")
    tx = F.get("transactions", F.col("tx_idx").cast("int"))
    out = F.get(tx["outputs"], F.col("_idx").cast("int"))
    j = rows.select("block_hash", F.col("tx_idx").cast("int").alias("tx_idx"), tx["tx_hash"].alias("tx_hash"),
                    F.col("_idx").alias("idx"), F.col("_idx"), F.col("_key"), "amount", out["script"].alias("script"))
    return _top_rows(j.where(_same_key(True)), with_script)


def _with_address(df: DataFrame, p2sh_version: int = 0) -> DataFrame:
    """Add ``hash160`` and ``address`` from the ``script`` column."""
    return with_address(df, "script", "address", "hash160", p2sh_version)


# The 20-byte hash of an address as integers of 14, 14 and 12 hex digits, so
# that it can ride through the numeric fold.
_PIECES = {"_h0": (1, 14), "_h1": (15, 14), "_h2": (29, 12)}
_ADDRESS_COLS = [*_PIECES, "_p2sh"]


def _with_hash_pieces(elements: DataFrame) -> DataFrame:
    """Key, type and amount with ``_h0, _h1, _h2, _p2sh`` of each output's
    address (NULL where it has none, and for inputs)."""
    script = F.when(F.col("type") == 1, F.col("script"))
    h = elements.select("type", *KEY, "amount", script_hash160_hex(script).alias("_h"),
                        F.octet_length(script).alias("_n"))
    return h.select("type", *KEY, "amount",
                    *[F.conv(F.substring("_h", at, n), 16, 10).cast("bigint").alias(c)
                      for c, (at, n) in _PIECES.items()],
                    # the P2SH template has 23 bytes, every P2PKH form at least 25
                    F.when(F.col("_h").isNotNull(), (F.col("_n") == 23).cast("int")).alias("_p2sh"))


def _unspent_with_hash(elements: DataFrame, compact: bool) -> DataFrame:
    """Key, amount and hash pieces of unspent outputs that have an address:
    one scan and one fold, no script is moved."""
    return (unspent_keys(_with_hash_pieces(elements), "amount", *_ADDRESS_COLS,
                         compact_keys=compact)
            .where(F.col("_p2sh").isNotNull()))


def _address_of_pieces(df: DataFrame, p2sh_version: int) -> DataFrame:
    """Add ``hash160`` and ``address`` from the hash pieces."""
    parts = [F.lpad(F.lower(F.hex(F.col(c))), n, "0") for c, (_, n) in _PIECES.items()]
    version = F.when(F.col("_p2sh") == 1, F.lit(f"{p2sh_version:02x}")).otherwise(F.lit("00"))
    return with_hash160_address(df.withColumn("hash160", F.concat(*parts)), "hash160",
                                "address", version)


def output_addresses(elements: DataFrame, p2sh_version: int = 0,
                     compact_keys: bool = False) -> DataFrame:
    """Unspent outputs that have an address: ``tx_hash, idx, address, hash160, balance``."""
    u = _address_of_pieces(_unspent_with_hash(elements, compact_keys), p2sh_version)
    return u.select(_tx_hash_of_key(compact_keys), "idx", "address", "hash160",
                    F.col("amount").alias("balance"))


def element_addresses(elements: DataFrame, p2sh_version: int = 0) -> DataFrame:
    """Address of every element (inputs included; NULL where none):
    ``type, tx_hash, idx, address``."""
    return _with_address(elements, p2sh_version).select("type", *KEY, "address")


def top_addresses(elements: DataFrame, k: int = 10_000, p2sh_version: int = 0,
                  compact_keys: bool = False) -> DataFrame:
    """The k largest unspent outputs that have an address: ``address, balance``.

    "Balance" is the value of one unspent output (the reference does not
    sum per address); one address can appear several times. The winners are
    chosen on numbers; Base58 runs on those k rows.
    """
    _, key = _keyed(elements, compact_keys)
    top = (_unspent_with_hash(elements, compact_keys)
           .orderBy(F.col("amount").desc(), *key).limit(k))
    # the winners are one partition already; coalesce keeps the optimizer from
    # moving Base58 into the limit, where a full sort would replace the top-k
    return (_address_of_pieces(top.coalesce(1), p2sh_version)
            .orderBy(F.col("amount").desc(), *key)
            .select("address", F.col("amount").alias("balance")))


def address_balances(elements: DataFrame, p2sh_version: int = 0,
                     compact_keys: bool = False) -> DataFrame:
    """Sum of unspent value per address: ``address, balance, n_outputs``.

    Grouped on the numeric pieces of the 20-byte hash with partial
    aggregation; Base58 text is computed once per address after the aggregate.
    """
    u = _unspent_with_hash(elements, compact_keys)
    if p2sh_version == 0:            # both kinds then share their address texts
        u = u.withColumn("_p2sh", F.lit(0))
    per = u.groupBy(*_ADDRESS_COLS).agg(F.sum("amount").alias("balance"),
                                        F.count(F.lit(1)).alias("n_outputs"))
    return _address_of_pieces(per, p2sh_version).select("address", "balance", "n_outputs")
