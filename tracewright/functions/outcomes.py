"""When an episode counts as a success. The rules differ on purpose and stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import at_least, best_of, bool_or_null, strip

#: Shares of a game's score that count as a win.
COOKING_PAIR_WIN, COOKING_SFT_WIN, SHOP_WIN, SLACK = 10.0 / 17.0, 5.0 / 17.0, 0.9, 1e-9
COOKING, SIMPLE_GAMES = "the_cooking_game", ("treasure_hunter", "coin_collector")


def by_progression(progression: Column) -> Column:
    return at_least(progression, 1.0)


def by_score(progression: Column, reward: Column, threshold: float = SHOP_WIN) -> Column:
    """The better of progression and reward reaches the threshold."""
    return at_least(best_of(progression, reward), threshold)


def by_game(task_slug: Column, progression: Column) -> Column:
    """A threshold for each text game; any other task is an error."""
    return (
        F.when(task_slug == COOKING, at_least(progression, COOKING_PAIR_WIN))
        .when(task_slug.isin(*SIMPLE_GAMES), at_least(progression, 1.0))
        .otherwise(F.raise_error(F.concat(F.lit("no win rule for task "), F.coalesce(task_slug, F.lit("<missing>")))).cast("boolean"))
    )


def by_finish(won: Column, progression: Column, done: Column, reward: Column) -> Column:
    """Won, or full progression, or ended with a reward."""
    return F.coalesce(won, F.lit(False)) | at_least(progression, 1.0) | (F.coalesce(done, F.lit(False)) & F.coalesce(reward > 0, F.lit(False)))


def for_training(task_slug: Column, won: Column, progression: Column, done: Column, reward: Column) -> Column:
    """The rule for supervised rows: lower for cooking, with slack, and the general one for unknown tasks."""
    return (
        F.when(task_slug == COOKING, at_least(progression, COOKING_SFT_WIN - SLACK))
        .when(task_slug.isin(*SIMPLE_GAMES), at_least(progression, 1.0 - SLACK))
        .otherwise(by_finish(won, progression, done, reward))
    )


def of_log(success: Column, won: Column, progression: Column, last_won: Column, last_progression: Column, total: Column) -> Column:
    """The first that is known: success, won, progression, the last step's won or progression, the return."""
    return F.coalesce(bool_or_null(success), bool_or_null(won), progression >= 1, bool_or_null(last_won), last_progression >= 1, total >= 1, F.lit(False))


def of_trace(success: Column, log_won: Column, trace_won: Column, progression: Column, any_won: Column) -> Column:
    return F.coalesce(bool_or_null(success), bool_or_null(log_won), bool_or_null(trace_won), F.when(at_least(progression, 1.0), True), any_won, F.lit(False))


def is_valid(aborted: Column, abort_reason: Column, status: Column, termination: Column) -> Column:
    """Not aborted by any of the four fields that may say so."""
    reason = F.lower(strip(termination))
    bad = F.lower(strip(status)).isin("aborted", "missing", "missing_trace", "corrupt", "corrupted_trace")
    return ~(F.coalesce(bool_or_null(aborted), F.lit(False)) | (strip(abort_reason) != "") | bad | (reason == "aborted") | reason.startswith("aborted:"))


def termination_reason(won: Column, lost: Column, truncated: Column, terminated: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(won), "won").when(yes(lost), "lost").when(yes(truncated), "truncated").when(yes(terminated), "terminated").otherwise("")
