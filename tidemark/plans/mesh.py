"""Many peers: edges synced in order, those that share no peer at once, until a round changes nothing."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .sync import PeerState, SyncOptions, sync

#: Syncs that run at once; each is a chain of jobs of its own.
AT_ONCE = 8


def chain(peers: list[str]) -> list[tuple[str, str]]:
    return list(zip(peers, peers[1:], strict=False))


def star(peers: list[str]) -> list[tuple[str, str]]:
    return [(peers[0], p) for p in peers[1:]]


def full(peers: list[str]) -> list[tuple[str, str]]:
    return list(combinations(peers, 2))


def classes(edges: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Edges in classes that share no peer. An edge comes after all earlier ones that it shares a peer with, so what each
    edge sees, and with it the result, is as if they ran one by one."""
    free: dict[str, int] = {}
    out: list[list[tuple[str, str]]] = []
    for x, y in edges:
        at = max(free.get(x, 0), free.get(y, 0))
        out += [[]] if at == len(out) else []
        out[at].append((x, y))
        free[x] = free[y] = at + 1
    return out


def sync_mesh(
    peers: dict[str, PeerState], edges: list[tuple[str, str]], options: SyncOptions | None = None, at_once: int = AT_ONCE,
    on_conflicts: Callable[[str, str, DataFrame], None] | None = None, given: dict[str, PeerState] | None = None,
) -> tuple[dict[str, PeerState], int]:
    """One round; each edge sees what the ones before it left. Returns the peers and how many edges changed something.

    Edges of a class run at once, each in a scheduler pool of its own, which share alike where the session has fair
    scheduling. States of peers that a later edge replaces are released, but for those in ``given`` (by default what came in).
    """
    peers, changed, kept = dict(peers), 0, {id(p) for p in (given or peers).values()}
    context = next(iter(peers.values())).entries.sparkSession.sparkContext

    def one(edge: tuple[str, str]) -> tuple[PeerState, PeerState, bool]:
        x, y = edge
        context.setLocalProperty("spark.scheduler.pool", f"{x}-{y}")
        try:
            return sync(peers[x], peers[y], options, on_conflicts=(lambda c: on_conflicts(x, y, c)) if on_conflicts else None)
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    for group in classes(edges):
        if len(group) == 1 or at_once == 1:
            found = [one(e) for e in group]
        else:
            with ThreadPoolExecutor(min(at_once, len(group))) as pool:
                found = list(pool.map(inheritable_thread_target(one), group))
        for (x, y), (a, b, moved) in zip(group, found, strict=True):
            for name, new in ((x, a), (y, b)):
                old, peers[name] = peers[name], new
                if moved and id(old) not in kept and old.tables is not new.tables:
                    old.release()
            changed += moved
    return peers, changed


def sync_until_stable(peers: dict[str, PeerState], edges: list[tuple[str, str]], most: int = 10, options: SyncOptions | None = None, at_once: int = AT_ONCE) -> tuple[dict[str, PeerState], list[int]]:
    """Rounds until none changes anything, and the changed edges of each."""
    peers, rounds, _ = converge(peers, edges, most, options, at_once, conflicts=False)
    return peers, rounds


def converge(
    peers: dict[str, PeerState], edges: list[tuple[str, str]], most: int = 10, options: SyncOptions | None = None, at_once: int = AT_ONCE, conflicts: bool = True,
) -> tuple[dict[str, PeerState], list[int], DataFrame | None]:
    """Peers and changed edges as above, and all conflicts that any edge met: ``round, a, b`` and the columns of conflicts."""
    given, rounds, written = dict(peers), [], []
    scratch = Scratch(next(iter(peers.values())).entries.sparkSession, "mesh-conflicts")

    def note(x: str, y: str, found: DataFrame) -> None:
        marked = found.select(F.lit(len(rounds) + 1).alias("round"), F.lit(x).alias("a"), F.lit(y).alias("b"), "*")
        written.append(scratch.save(marked, f"{len(rounds)}-{len(written)}-{x}-{y}"))

    while len(rounds) < most:
        peers, changed = sync_mesh(peers, edges, options, at_once, note if conflicts else None, given)
        rounds.append(changed)
        if not changed:
            break
    return peers, rounds, reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), written) if written else None
