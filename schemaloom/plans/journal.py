"""What has been done of a plan, command by command, so that a run that stopped can be taken up where it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..relations import local_frame
from .compare import Plan
from .options import GUARDS

_TOLD = ("phase", "op", "table_key", "object_key", "name", "sql")
TABLE = "SCHEMALOOM_JOURNAL"


def digest(plan: Plan) -> str:
    """Of all commands of a plan; equal plans have equal ones, whenever they are made."""
    text = F.to_json(F.struct(*_TOLD))
    words = [F.bit_xor(F.xxhash64(text, F.lit(seed))).alias(f"w{seed}") for seed in range(4)]
    return "".join(f"{x & (1 << 64) - 1:016x}" for x in plan.commands.agg(*[F.coalesce(w, F.lit(0)) for w in words], F.count("*")).first())


def command_id() -> Column:
    """What a command is known by in a plan, whatever its place."""
    return F.sha2(F.to_json(F.struct(*_TOLD)).cast("binary"), 256)


class Journal:
    """A ledger in the target database itself, so that in a dialect with transactions a command and its entry are one: both are there or neither.

    connection is a DB-API connection; entries are written by whoever runs the commands, in the same transaction.
    """

    def __init__(self, connection):
        self.connection = connection

    def _run(self, sql: str) -> list[tuple]:
        cursor = self.connection.cursor()
        cursor.execute(sql)
        return cursor.fetchall() if cursor.description else []

    def prepare(self) -> None:
        """Makes the table if it is not there. Not inside of a transaction."""
        try:
            self._run(f"SELECT COUNT(*) FROM {TABLE}")
        except Exception:  # every driver has its own error for a table that is missing
            self.connection.rollback()
            self._run(f"CREATE TABLE {TABLE} (PLAN_ID VARCHAR(100) NOT NULL, COMMAND_ID VARCHAR(64) NOT NULL, PRIMARY KEY (PLAN_ID, COMMAND_ID))")
            self.connection.commit()

    def note(self, plan: str, command: str) -> None:
        self._run(f"INSERT INTO {TABLE} (PLAN_ID, COMMAND_ID) VALUES ('{plan}', '{command}')")

    def done(self, plan: str) -> list[str]:
        """The commands of a plan that are done: 64 signs for each."""
        return [r[0] for r in self._run(f"SELECT COMMAND_ID FROM {TABLE} WHERE PLAN_ID = '{plan}'")]


def marked(plan: Plan, journal: Journal) -> DataFrame:
    """The plan's commands with command_id and done, by a join with the journal's entries. Guards are never done: what they switch holds for a connection."""
    done = local_frame(plan.commands.sparkSession, [(x, True) for x in journal.done(digest(plan))], "command_id string, done boolean")
    rows = plan.commands.withColumn("command_id", command_id()).join(done, "command_id", "left")
    return rows.withColumn("done", F.coalesce("done", F.lit(False)) & ~F.col("op").isin(*GUARDS))
