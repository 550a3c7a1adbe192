"""Saved searches matched in reverse: events look up the searches that may match them.

Every search is indexed under one *anchor*, a token that each matching event must have:

* the rarest of its positive tag tests ``key=value`` (stored tag tokens of an event are its tokens);
* without one, the rarest trigram of its raw texts (lower-cased; a matching event has all of them in its message or title);
* without either (only negations, or texts under three characters) the token ``*`` of every event of its project.

How rare a token is among the events of the project is counted first, in one pass over the tokens that searches ask for;
a search whose rarest token never occurs matches nothing and is left out.  Then events are exploded into their tokens,
meet the anchors on (pid, token), and what is left is verified against window and whole query.  Trigrams and ``*`` are
emitted only in projects that have such anchors.  So an event meets the searches whose anchor it has, not all searches of
its project; searches of equal project, query and window are matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import predicates as P
from faultline.operators import analytics as Q

ANY = "*"


def _trigrams(text: Column) -> Column:
    """Overlapping runs of three characters, lower-cased; none in a shorter text."""
    return F.regexp_extract_all(P.ascii_lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _marked(mark: str, tokens: Column) -> Column:
    """Tag tokens and trigrams are told apart by their first character."""
    return F.transform(tokens, lambda t: F.concat(F.lit(mark), t))


def search_tokens(query: Column) -> Column:
    """Tokens of which a matching event must have every one: tag tests if there are any, else trigrams."""
    parsed = P.query_tokens(query)
    tags = F.transform(F.filter(parsed, lambda t: ~t["is_raw_text"] & (t["operator"] == P.IS)),
                       lambda t: F.concat(t["key"], F.lit("="), t["value"]))
    grams = F.flatten(F.transform(F.filter(parsed, lambda t: t["is_raw_text"]), lambda t: _trigrams(t["value"])))
    return F.array_distinct(F.when(F.size(tags) > 0, _marked("t", tags)).when(F.size(grams) > 0, _marked("g", grams))
                            .otherwise(F.array(F.lit(ANY))))


def _event_tokens(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Events of projects that have searches, with ``token``, each token of an event once."""
    wants = asked.groupBy(F.col("pid").alias("_pid")).agg(
        F.bool_or(F.col("token").startswith("g")).alias("_grams"), F.bool_or(F.col("token") == ANY).alias("_any"))
    tags = F.array_distinct(_marked("t", F.transform(F.coalesce("tags", F.array().cast("array<struct<key:string,value:string>>")),
                                    lambda t: P.stored_tag_token(t["key"], t["value"]))))
    none = F.array().cast("array<string>")
    message, title = F.coalesce("message", F.lit("")), F.coalesce("title", F.lit(""))
    # A title that holds the message has its trigrams, too.
    grams = F.concat(_trigrams(title), F.when(title.contains(message), none).otherwise(_trigrams(message)))
    tokens = F.concat(
        F.filter(tags, lambda t: t.isNotNull()),
        F.when(F.col("_grams"), _marked("g", F.array_distinct(grams))).otherwise(none),
        F.when(F.col("_any"), F.array(F.lit(ANY))).otherwise(none))
    j = events.join(wants, F.col("pid") == F.col("_pid"))
    return j.select(*events.columns, F.explode(tokens).alias("token"))


def anchors(events: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, pid, token): the rarest required token of each search that may match anything."""
    asked = searches.select("search_id", "pid", F.explode(search_tokens(F.col("query"))).alias("token"))
    known = asked.select("pid", "token").distinct()
    seen = _event_tokens(events.select("pid", "message", "title", "tags"), known).select("pid", "token")
    count = seen.join(known, ["pid", "token"], "left_semi").groupBy("pid", "token").agg(F.count(F.lit(1)).alias("n"))
    best = asked.join(count, ["pid", "token"], "left").groupBy("search_id", "pid").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("b"))
    return best.where("b.n > 0").select("search_id", "pid", "b.token")


def saved_search_matches(events: DataFrame, searches: DataFrame) -> DataFrame:
    """P6 as a job: searches(search_id, pid, query, frm, to) -> per search the matching live events of its project and
    window, and their issues.  A null query matches nothing, an empty one every event."""
    bounds = searches.agg(F.min("frm").alias("lo"), F.max("to").alias("hi")).first()  # one row: the weeks to read
    same = ["pid", "query", "frm", "to"]
    once = searches.where(F.col("query").isNotNull()).groupBy(*same).agg(F.min("search_id").alias("search_id"))
    if bounds["lo"] is None or bounds["hi"] is None:
        ev = events.limit(0)
    else:
        ev = Q.live_between(events, bounds["lo"], bounds["hi"], True)
    ev = ev.select("pid", "gid", "created_at", "message", "title", "tags")
    at = anchors(ev, once)
    index = at.join(once.select("search_id", "frm", "to", P.query_tokens(F.col("query")).alias("tokens")), "search_id")
    found = _event_tokens(ev, at).join(index, ["pid", "token"])
    found = found.where((F.col("created_at") >= F.col("frm")) & (F.col("created_at") <= F.col("to")))
    hits = found.where(P.tokens_match(F.col("tokens"), F.col("message"), F.col("title"), F.col("tags")))
    counts = hits.groupBy("search_id").agg(
        F.count(F.lit(1)).alias("match_events"), F.count_distinct("gid").alias("match_issues"))
    counts = once.join(counts, "search_id").select(*[F.col(c).alias(f"_{c}") for c in same], "match_events", "match_issues")
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    j = searches.join(counts, equal[0] & equal[1] & equal[2] & equal[3], "left")
    return j.select(
        "search_id", F.coalesce("match_events", F.lit(0)).cast("bigint").alias("match_events"),
        F.coalesce("match_issues", F.lit(0)).cast("bigint").alias("match_issues"))
