"""Crawling policies: parsed and matched as DataFrames. A decision never authorises access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import holds
from ..sources.frozen import freeze

#: Limits (fixed values): bytes of a policy, characters of a target or line, seconds of delay, steps of matching.
MOST_POLICY, MOST_TARGET, MOST_DELAY, MOST_STEPS = 512_000, 8_192, 3_600, 2_000_000
TOKEN = r"\A[A-Za-z_-]+\z"
DIRECTIVES = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay")
#: Stands before each octet, so that a part of a pattern is only found where an octet begins.
MARK = "\x01"
_UNRESERVED = r"[A-Za-z0-9._~-]"
#: Characters that are octets as they are.
_PLAIN = r"-A-Za-z0-9._~/:?\[\]@!&'()+,;="


def octets(text: Column, pattern: bool = False) -> Column:
    """Array of comparable octets of a path; ``*`` stands for any run in a pattern.

    Percent escapes of unreserved characters are decoded, others written in capitals; characters that
    need an escape get one, byte by byte. Null if an escape is malformed.
    """
    units = F.regexp_extract_all(text, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|.)"), 1)

    def one(u: Column) -> Column:
        char = F.chr(F.conv(F.substring(u, 2, 2), 16, 10).cast("int"))
        escaped = F.when(char.rlike(rf"\A{_UNRESERVED}\z"), F.array(char)).otherwise(F.array(F.upper(u)))
        bytes_ = F.transform(F.regexp_extract_all(F.hex(F.encode(u, "UTF-8")), F.lit("(..)"), 1), lambda h: F.concat(F.lit("%"), h))
        plain = u.rlike(rf"\A({_UNRESERVED}|[/:?\[\]@!&'()+,;=])\z")
        kept = F.when(F.length(u) == 3, escaped).when(plain, F.array(u)).otherwise(bytes_)
        return F.when((u == "*") & F.lit(pattern), F.array(F.lit("*"))).otherwise(kept)

    every = F.when(~text.rlike("%(?![0-9A-Fa-f]{2})"), F.flatten(F.transform(units, one)))
    return F.when(text.rlike(rf"\A[{_PLAIN}{'*' if pattern else ''}]*\z"), F.regexp_extract_all(text, F.lit("."), 0)).otherwise(every)


def parse(policies: DataFrame, most: int | None = MOST_POLICY) -> DataFrame:
    """``(policy_id, group, line, directive, value, problem)`` of every effective line of ``policies(policy_id, body)``.

    A run of user-agent lines opens a group, which goes on to the next such run. ``problem`` says why
    a line (or, on line 0, the whole body) needs review. Lines are numbered within a policy, whose size is bounded by ``most`` bytes.
    """
    text = F.regexp_replace(F.try_validate_utf8("body").cast("string"), "\\A\ufeff", "")
    whole = (
        F.when((F.octet_length("body") > most) if most is not None else F.lit(False), "oversized").when(text.isNull(), "not UTF-8")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]") | F.lower(text).contains("<html") | F.lower(text).contains("<!doctype"), "not plain text")
    )
    judged = policies.select("policy_id", whole.alias("whole"), F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n").alias("raws"))  # once for a policy, not for each line
    lines = judged.select("policy_id", "whole", F.posexplode_outer("raws").alias("at", "raw"))
    stripped = F.regexp_replace(F.substring_index("raw", "#", 1), r"\A[ \t]+|[ \t]+\z", "")
    lines = lines.withColumn("text", stripped).where((F.col("text") != "") | (F.col("at") == 0))
    name = F.lower(F.regexp_replace(F.substring_index("text", ":", 1), r"[ \t]+\z", ""))
    value = F.regexp_replace(F.regexp_extract("text", r"\A[^:]*:(.*)\z", 1), r"\A[ \t]+", "")
    lines = lines.withColumn("directive", F.when(F.col("text") != "", name)).withColumn("value", value)
    order = Window.partitionBy("policy_id").orderBy("at")
    grouping = lines.where(F.col("directive").isin("user-agent", "allow", "disallow", "crawl-delay"))
    opens = (F.col("directive") == "user-agent") & F.coalesce(F.lag("directive").over(order) != "user-agent", F.lit(True))
    groups = grouping.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("int")).over(order)).select("policy_id", "at", "group")
    d, v = F.col("directive"), F.col("value")
    problem = (
        F.when((F.col("at") == 0) & F.col("whole").isNotNull(), F.col("whole"))
        .when((F.length("text") > 8_192) | (d.isNotNull() & ~F.col("text").contains(":")), "malformed line")
        .when(d.isNotNull() & ~d.isin(*DIRECTIVES), "unknown directive")
        .when((d == "sitemap") & (v == ""), "empty sitemap")
        .when((d == "user-agent") & ~(v.rlike(TOKEN) | (v == "*")), "invalid product token")
        .when(d.isin("allow", "disallow", "crawl-delay") & (F.coalesce("group", F.lit(0)) == 0), "rule before any user-agent")
        .when((d == "crawl-delay") & ~(holds(v.rlike(r"\A[0-9]+(\.[0-9]+)?\z") & (v.try_cast("double") <= MOST_DELAY))), "unsupported delay")
        .when(d.isin("allow", "disallow") & (v != "") & (~v.rlike(r"\A[/*]") | v.rlike(r"\s") | v.rlike(r"\$.")), "malformed path rule")
        .when(d.isin("allow", "disallow") & v.rlike("%(?![0-9A-Fa-f]{2})"), "malformed escape")
    )
    out = lines.join(groups, ["policy_id", "at"], "left")
    return out.select("policy_id", "group", (F.col("at") + 1).alias("line"), "directive", "value", problem.alias("problem")).where("directive is not null or problem is not null")


def rules(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``rule``: for effective path rules a struct of group, line, allow, pattern, atoms, segments, end, specificity and size.

    A run of wildcards is one, and one at the end is dropped with an end mark after it. Specificity is
    the number of octets, wildcards and the end mark included.
    """
    is_rule = F.col("directive").isin("allow", "disallow") & (F.col("value") != "") & F.col("problem").isNull()
    bare = F.regexp_replace(F.regexp_replace("value", r"\$\z", ""), r"\*+", "*")
    rows = parsed.withColumn("atoms", F.when(is_rule, octets(bare, pattern=True)))
    trailing = F.coalesce(F.try_element_at("atoms", F.lit(-1)) == "*", F.lit(False))
    rows = rows.withColumn("end", F.col("value").endswith("$") & ~trailing).withColumn("atoms", F.when(trailing, F.slice("atoms", F.lit(1), F.size("atoms") - 1)).otherwise(F.col("atoms")))
    segments = F.split(F.array_join(F.transform("atoms", lambda a: F.when(a == "*", a).otherwise(F.concat(F.lit(MARK), a))), ""), r"\*")
    rule = F.struct("group", "line", (F.col("directive") == "allow").alias("allow"), F.col("value").alias("pattern"), F.col("atoms").alias("atoms"), segments.alias("segments"), F.col("end").alias("end"), (F.size("atoms") + F.col("end").cast("int")).alias("specificity"), F.size("atoms").alias("size"))
    return rows.withColumn("rule", F.when(F.col("atoms").isNotNull(), rule)).drop("atoms", "end")


def matches(text: Column, segments: Column, end: Column) -> Column:
    """Whether a target has the parts of a pattern between its wildcards in order: the first at its start, with ``end`` the last at its end.

    Each part is looked for once, from where the one before it ended; the earliest place is as good as any
    later one, so nothing is tried again and the work is at most the target's octets times the pattern's.
    """
    first, last = F.element_at(segments, 1), F.element_at(segments, -1)
    middle = F.when(end, F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 2, F.lit(0)))).otherwise(F.slice(segments, F.lit(2), F.size(segments)))

    def step(at: Column, part: Column) -> Column:
        found = F.position(part, text, at)
        return F.when(at == 0, at).when(found > 0, found + F.length(part)).otherwise(0)

    reached = F.aggregate(middle, F.length(first) + 1, step)
    closed = F.when(F.size(segments) == 1, text == first).otherwise(text.endswith(last) & (F.length(text) - F.length(last) + 1 >= reached))
    return text.startswith(first) & (reached > 0) & (~end | closed)


def most_steps(n: Column, rule: Column) -> Column:
    """At most so many steps takes :func:`steps` over a target of ``n`` octets; a pattern without wildcards has one state at a time."""
    size = rule["size"].cast("long")
    return F.when(F.size(rule["segments"]) == 1, 2 * size + 2).otherwise((2 * n + 1) * (size + 1))


def steps(target: Column, text: Column, rule: Column, spent: Column, most: int = MOST_STEPS) -> Column:
    """``spent`` and the steps of matching a rule, counted as they are made, up to a little over ``most``.

    A state is a number of atoms that are matched; a wildcard's state stays and opens the next one. Each state entered is a step, and each
    asked for its next octet is one. Matching ends where no state is left, or where a pattern without an end mark is through. Octets that no state can
    reach are left out beforehand: beyond a first part that the target does not begin with, or beyond the whole of a pattern without wildcards.
    """
    atom, size, first = lambda p: F.get(rule["atoms"], p), rule["size"], F.element_at(rule["segments"], 1)
    none = F.array().cast("array<int>")
    entered = lambda p: F.when(atom(p) == "*", F.array(p, p + 1)).otherwise(F.array(p))
    going = lambda states: F.when(~rule["end"] & F.array_contains(states, size), none).otherwise(states)
    state = lambda cost, states: F.struct(cost.alias("cost"), going(states).alias("states"))

    def step(s: Column, octet: Column) -> Column:
        moved = lambda p: F.when(atom(p) == "*", F.array(p, p + 1)).when(atom(p) == octet, entered(p + 1)).otherwise(none)
        reached = F.array_distinct(F.flatten(F.transform(s["states"], moved)))
        return F.when((F.size(s["states"]) == 0) | (s["cost"] > most), s).otherwise(state(s["cost"] + F.size(s["states"]) + F.size(reached), reached))

    begun = entered(F.lit(0))
    octets_first = F.regexp_count(first, F.lit(MARK)) + 1
    reach = F.when(F.size(rule["segments"]) == 1, size + 1).when(text.startswith(first), F.size(target)).otherwise(octets_first)
    return F.aggregate(F.slice(target, F.lit(1), reach), state(spent + F.size(begun), begun), step)["cost"]


def profiles(policies: DataFrame, most: int | None = MOST_POLICY) -> DataFrame:
    """``(policy_id, problem, agents, delays, rules)``: each policy as one row, bounded by the size of a policy."""
    d, fine = F.col("directive"), F.col("problem").isNull()
    agent = F.when((d == "user-agent") & fine, F.struct("group", F.lower("value").alias("agent")))
    delay = F.when((d == "crawl-delay") & fine, F.struct("group", F.col("value").try_cast("double").alias("delay")))
    return rules(parse(policies, most)).groupBy("policy_id").agg(
        F.min(F.when(~fine, F.struct("line", "problem")))["problem"].alias("problem"), F.collect_list(agent).alias("agents"), F.collect_list(delay).alias("delays"), F.collect_list("rule").alias("rules"),
    )


def _plain(rule: Column) -> Column:
    """Whether a rule has no wildcard between octets, so that it holds where the target begins with it."""
    return F.size(rule["segments"]) == 1


def _summaries(ruled: DataFrame) -> DataFrame:
    """``(policy_id, problem, agents, delays, wild, work, sizes)``: a policy without its plain rules, of which ``sizes`` has the numbers of octets.

    ``work`` is what :func:`most_steps` of all rules of a group comes to: ``fixed``, and ``each`` for every ``2 n + 1`` of a target of n octets.
    """
    rule, none = F.col("rule"), F.lit(0).cast("long")
    plain, size = F.coalesce(_plain(rule), F.lit(False)), rule["size"].cast("long")
    fixed, each = F.sum(F.when(plain, 2 * size + 2).otherwise(none)), F.sum(F.when(rule.isNotNull() & ~plain, size + 1).otherwise(none))
    wild, sizes = F.collect_list(F.when(~plain, rule)), F.collect_set(F.when(plain, rule["size"]))
    d, fine = F.col("directive"), F.col("problem").isNull()
    agents, delays = F.collect_set(F.when((d == "user-agent") & fine, F.lower("value"))), F.max(F.when((d == "crawl-delay") & fine, F.col("value").try_cast("double")))
    problem = F.min(F.when(~fine, F.struct("line", "problem")))
    groups = ruled.groupBy("policy_id", "group").agg(problem.alias("problem"), agents.alias("agents"), delays.alias("delay"), wild.alias("wild"), sizes.alias("sizes"), fixed.alias("fixed"), each.alias("each"))
    flat = lambda c: F.flatten(F.collect_list(c))
    return groups.groupBy("policy_id").agg(
        F.min("problem")["problem"].alias("problem"), flat(F.transform("agents", lambda a: F.struct("group", a.alias("agent")))).alias("agents"), F.collect_list(F.when(F.col("delay").isNotNull(), F.struct("group", "delay"))).alias("delays"),
        flat("wild").alias("wild"), F.collect_list(F.struct("group", "fixed", "each")).alias("work"), F.array_distinct(flat("sizes")).alias("sizes"),
    )


def _plain_hits(asked: DataFrame, summaries: DataFrame, ruled: DataFrame) -> DataFrame:
    """``(policy_id, text, plain_hits)``: the plain rules that hold for each target that is asked of a policy.

    A target is cut to each size that the policy's plain rules have, and what is left is looked up; so the work grows with the targets and not with targets times rules.
    """
    targets = asked.where("target is not null").select("policy_id", "text", "target").distinct()
    cuts = targets.join(summaries.select("policy_id", "sizes"), "policy_id").withColumn("n", F.size("target"))
    cuts = cuts.select("policy_id", "text", "target", "n", F.explode(F.filter("sizes", lambda k: k <= F.col("n"))).alias("k")).select("policy_id", "text", (F.col("k") == F.col("n")).alias("whole"), F.array_join(F.slice("target", F.lit(1), F.col("k")), "").alias("begins"))
    hit = F.struct("rule.group", "rule.line", "rule.allow", "rule.specificity", "rule.end")
    known = ruled.where(_plain(F.col("rule"))).groupBy("policy_id", F.array_join("rule.atoms", "").alias("begins")).agg(F.collect_list(hit).alias("at"))
    met = cuts.join(known, ["policy_id", "begins"]).select("policy_id", "text", F.filter("at", lambda r: ~r["end"] | F.col("whole")).alias("at"))
    return met.groupBy("policy_id", "text").agg(F.flatten(F.collect_list(F.transform("at", _brief))).alias("plain_hits"))


def _brief(rule: Column) -> Column:
    return F.struct(*[rule[n].alias(n) for n in ("group", "line", "allow", "specificity")])


def decide(policies: DataFrame, requests: DataFrame, bounded: bool = True) -> DataFrame:
    """RB4: ``(request_id, status, selection, delay, winners, reason)`` for ``requests(request_id, policy_id, url, token)``.

    All groups that name the token apply, or else those for ``*``. The longest matching rule wins, of
    equal ones an Allow. ``/robots.txt`` itself is always allowed. Anything malformed needs review, and so does more work than the
    bound on the steps of matching all rules that apply. Only where sizes alone do not show that it is less are the steps
    counted. Requests meet their policy in joins and are decided row by row, so their number and how many share a policy do not matter. Rules
    without wildcards are looked up by the beginnings of a target, those with wildcards tried one by one. The bounds on a policy's bytes and on steps are lifted if not ``bounded``.
    """
    most_policy, most_work = (MOST_POLICY, MOST_STEPS) if bounded else (None, None)
    url = F.col("url")
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    shown = F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    host = F.regexp_extract(url, r"\A(?i:https?)://([^/?#]+)", 1)
    fault = (
        F.when(~holds(F.col("token").rlike(TOKEN)), "invalid product token")
        .when(url.isNull() | (F.length(url) > MOST_TARGET) | url.rlike(r"[\x00-\x1f\x7f]"), "invalid target")
        .when((host == "") | host.contains("@") | url.rlike("#."), "unsupported target")
        .when(shown.rlike("%(?![0-9A-Fa-f]{2})"), "malformed escape")
    )
    asked = requests.select("request_id", "policy_id", F.lower("token").alias("token"), fault.alias("fault"), octets(shown).alias("target"), ((path == "/robots.txt") & (query == "")).alias("own_file"))
    asked = asked.withColumn("text", F.array_join(F.transform("target", lambda o: F.concat(F.lit(MARK), o)), ""))
    ruled = freeze(rules(parse(policies, most_policy)))  # read by rule, by policy and by beginning
    known = _summaries(ruled)
    met = asked.join(known.drop("sizes"), "policy_id", "left")
    met = met.withColumn("by_name", F.coalesce(F.exists("agents", lambda a: a["agent"] == F.col("token")), F.lit(False)))
    wanted = F.when(F.col("by_name"), F.col("token")).otherwise("*")
    met = met.withColumn("groups", F.array_distinct(F.transform(F.filter("agents", lambda a: a["agent"] == wanted), lambda a: a["group"])))
    mine = lambda column: F.filter(column, lambda x: F.array_contains("groups", x["group"]))
    met = met.withColumn("tried", mine("wild")).withColumn("delay", F.array_max(F.transform(mine("delays"), lambda x: x["delay"])))
    held = F.coalesce("fault", "problem")
    if most_work is not None:
        none = F.lit(0).cast("long")
        may = F.aggregate(mine("work"), none, lambda n, w: n + w["fixed"] + (2 * F.size("target").cast("long") + 1) * w["each"])
        # without a wildcard the steps are bounded by the rules alone
        bound = F.aggregate("rules", none, lambda n, r: n + 2 * r["size"].cast("long") + 2)
        every = profiles(policies, most_policy).where(F.exists("rules", lambda r: ~_plain(r)) | (bound > most_work)).select(F.col("policy_id").alias("of"), F.col("rules").alias("every"))
        met = met.withColumn("much", F.coalesce(held.isNull() & (may > most_work), F.lit(False))).join(every, F.col("much") & (F.col("policy_id") == F.col("of")), "left")
        made = F.aggregate(mine("every"), none, lambda n, r: F.when(n > most_work, n).otherwise(steps(F.col("target"), F.col("text"), r, n, most_work)))
        met = met.withColumn("held", F.coalesce(held, F.when(F.col("much") & (made > most_work), "too much work"))).drop("of", "every", "much")
    else:
        met = met.withColumn("held", held)
    met = met.join(_plain_hits(asked, known, ruled), ["policy_id", "text"], "left")
    hits = F.concat(F.transform(F.filter("tried", lambda r: matches(F.col("text"), r["segments"], r["end"])), _brief), F.coalesce(mine("plain_hits"), F.array()))
    met = met.withColumn("hits", F.when(F.col("held").isNull() & ~F.col("own_file"), hits))
    best = F.array_max(F.transform("hits", lambda r: r["specificity"]))
    met = met.withColumn("won", F.filter("hits", lambda r: r["specificity"] == best))
    allowed = (F.coalesce(F.size("won"), F.lit(0)) < 1) | F.exists("won", lambda r: r["allow"])
    selection = F.when(F.col("by_name"), "exact_product_token").when(F.size("groups") > 0, "wildcard_fallback").otherwise("no_applicable_group")
    decided = F.col("held").isNull()
    lines = F.coalesce(F.sort_array(F.transform("won", lambda r: r["line"])), F.array().cast("array<int>"))
    return met.select(
        "request_id", F.when(~decided, "review_required").when(allowed, "allow").otherwise("disallow").alias("status"), F.when(decided, selection).alias("selection"),
        F.when(decided, F.coalesce("delay", F.lit(0.0))).alias("delay"), F.when(decided, lines).alias("winners"), F.col("held").alias("reason"),
    )


def waiting(decisions: DataFrame, least: float = 1.1, most: float = 10.0) -> DataFrame:
    """M6: ``(delay, hold)``: all targets must be allowed, and the longest delay asked for must be bearable."""
    worst = F.greatest(F.lit(least), F.max("delay"))
    return decisions.agg(worst.alias("delay"), ((F.count_if(F.col("status") != "allow") > 0) | (worst > most) | (F.count("*") == 0)).alias("hold"))
