"""Joins whose small side is broadcast only after its size has been checked."""

from pyspark.sql import functions as F

from weighyard.session import shared_dir

BROADCAST_ROWS = 100_000


def settle(df):
    """Write the rows to the checkpoint folder and go on from there.

    Unlike a cache this survives the loss of executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df, max_rows=BROADCAST_ROWS):
    """Whether a settled table is small enough; it holds a few numbers per row."""
    return df.count() <= max_rows


def lookup_join(facts, lookup, on, how="left", max_rows=BROADCAST_ROWS):
    """Join a fact table to a per-key table without moving the facts where possible.

    The lookup is settled first, so its size is known before the join is planned and it
    is computed once. Up to `max_rows` it is broadcast and the facts stay where they are;
    beyond that the join is a shuffle join, in which adaptive execution splits hot keys.
    """
    settled = settle(lookup)
    if fits_broadcast(settled, max_rows):
        settled = F.broadcast(settled)
    return facts.join(settled, on, how)
