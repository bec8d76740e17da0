"""Attribution of outcomes to evidence chains: a fold whose state is the set of places that carry the planted fact, with rules around it.

A chain is one predicate of an item (a hook): it is valid if every remembered unit it cites leads back, through places that already carry the fact, to the place
where the fact was planted. Items without chains, or without some table's rows, take the rule's answer for nothing found; null flags count as false, null places as unknown (never
inside a window, never a carrier). A chain's anchors are one row in the fold: they are citations of one item, some dozens, and don't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Routes that count as tried and as causal, kinds of provenance, and the roles that a local resolution needs.
VALID_ROUTES = ["attempted", "auxiliary", "essential"]
CAUSAL_ROUTES = ["auxiliary", "essential"]
TRACED = ["D", "T"]
ROLES = ["problem", "resource", "operation", "mechanism", "result", "continuity"]


def _true(c) -> F.Column:
    return F.coalesce(c, F.lit(False))


def valid_chains(hooks: DataFrame, chains: DataFrame, outputs: DataFrame, history: DataFrame, sources: DataFrame) -> DataFrame:
    """hook, predicate, valid of every chain.

    hooks: hook, plant, window_start, window_end, scoring (array). chains: hook, predicate, provenance, disclosed, laundered, conflict, used. Anchors, by hook and
    predicate: outputs (place, grounded), history (place, unit, grounded, in_prompt, cap, unit_sources (array)), sources (unit, place, grounded).
    Valid is a chain of a traced provenance that is used, neither disclosed, laundered nor in conflict, and has all three kinds of anchors, if: outputs are
    grounded and inside the window; the last history anchor's place is a scoring place with an output; history and sources name the same units; and in order of place (then
    unit) each history anchor is grounded, not in the prompt, its sources are grounded, earlier, among its unit's sources, and one of them is a carrier: the
    planted place or the place of an earlier history anchor. A direct chain (D) must end in a unit that is capped D and draws on the planted place.
    """
    key = ["hook", "predicate"]
    h = hooks.select("hook", "plant", "window_start", "window_end", "scoring")
    out = outputs.join(h, "hook").groupBy(*key).agg(
        F.min(_true(F.col("grounded") & F.col("place").between(F.col("window_start"), F.col("window_end")))).alias("_out_ok"), F.collect_set("place").alias("_out")
    )
    of_unit = sources.groupBy(*key, "unit").agg(F.collect_set("place").alias("_from"), F.min(_true(F.col("grounded") & F.col("place").isNotNull())).alias("_from_ok"))
    met = history.withColumn("_cited", F.lit(True)).join(of_unit.withColumn("_has", F.lit(True)), [*key, "unit"], "full_outer")
    inside = F.forall("_from", lambda p: F.array_contains("unit_sources", p) & (p < F.col("place")))
    fine = _true(F.col("grounded")) & ~_true(F.col("in_prompt")) & _true(F.col("_from_ok")) & _true(inside)
    row = F.struct("place", "unit", _true(fine).alias("ok"), F.coalesce("_from", F.array().cast("array<int>")).cast("array<int>").alias("from"), F.col("cap"), F.col("unit_sources").alias("drawn"))
    told = met.groupBy(*key).agg(
        F.min(_true(F.col("_cited") & F.col("_has") & (F.col("unit") != ""))).alias("_same_units"), F.array_sort(F.collect_list(F.when(F.col("_cited"), row))).alias("_rows")
    )
    all_of = chains.join(h, "hook").join(out, key, "left").join(told, key, "left")
    start = F.struct(F.array(F.col("plant").cast("int")).alias("carriers"), F.lit(True).alias("ok"))

    def step(state, anchor):
        carried = _true(F.arrays_overlap(state["carriers"], anchor["from"]))
        return F.struct(F.concat(state["carriers"], F.array(anchor["place"].cast("int"))).alias("carriers"), (state["ok"] & anchor["ok"] & carried).alias("ok"))

    last = F.element_at("_rows", -1)
    ends = F.array_contains("scoring", last["place"]) & F.array_contains("_out", last["place"])
    direct = (F.col("provenance") != "D") | ((last["cap"] == "D") & F.array_contains(last["drawn"], F.col("plant")))
    flags = F.col("provenance").isin(TRACED) & F.col("used") & ~_true(F.col("disclosed")) & ~_true(F.col("laundered")) & ~_true(F.col("conflict"))
    whole = _true(flags) & _true(F.col("_out_ok")) & _true(F.col("_same_units")) & _true(F.size("_rows") > 0)
    return all_of.select(*key, F.when(whole, _true(ends) & _true(direct) & F.aggregate("_rows", start, step)["ok"]).otherwise(F.lit(False)).alias("valid"))


def local_resolutions(hooks: DataFrame, resolutions: DataFrame, anchors: DataFrame, prompts: DataFrame, histories: DataFrame) -> DataFrame:
    """hook, local: whether the item was resolved on the spot, with support of the kind that its subtype names.

    hooks: hook, trigger, window_start, window_end, last. resolutions: hook, basic (all plain conditions hold), subtype. anchors: hook, role, place, grounded;
    prompts: hook, grounded; histories: hook, grounded, unit_sources.
    """
    h = hooks.select("hook", "trigger", "window_start", "window_end", "last")
    place = F.col("place")
    within = place.between(F.col("window_start"), F.col("window_end"))
    role = lambda name: F.when(F.col("role") == name, place)
    fine = F.col("grounded") & (~F.col("role").isin("operation", "mechanism", "result") | within) & ((F.col("role") != "problem") | within | (place == F.col("trigger")))
    seen = anchors.join(h, "hook").groupBy("hook").agg(
        F.min(_true(fine)).alias("_fine"), F.collect_set("role").alias("_roles"), F.min(role("operation")).alias("_op"), F.max(role("result")).alias("_result"), F.min(role("mechanism")).alias("_mechanism"),
        F.min(role("resource")).alias("_resource"), F.min(role("problem")).alias("_problem"), F.min(role("verification")).alias("_verified"), F.collect_set(role("continuity")).alias("_after"),
    )
    prompt = prompts.groupBy("hook").agg(F.min(_true(F.col("grounded"))).alias("_prompt"))
    past = histories.join(h, "hook").groupBy("hook").agg(F.min(_true(F.col("grounded") & (F.array_min("unit_sources") < F.col("trigger")))).alias("_past"))
    all_of = resolutions.join(h, "hook")
    for side in (seen, prompt, past):
        all_of = all_of.join(side, "hook", "left")
    ordered = (F.col("_resource") <= F.col("_op")) & (F.col("_problem") <= F.col("_op")) & (F.col("_op") <= F.col("_result")) & (F.col("_mechanism") <= F.col("_result"))
    limit = F.least(F.col("last"), F.col("window_end") + 3)
    carried_on = F.exists("_after", lambda p: (p > F.col("_result")) & (p <= limit))
    kinds = [_true(F.col("_prompt")), _true(F.col("_past")), _true(F.col("_verified") <= F.col("_op"))]
    support = F.col("subtype")
    backed = F.when(support == "prompt_scaffolded", kinds[0]).when(support == "historical_alternative", kinds[1]).when(support == "window_verified", kinds[2]).when(support == "mixed", sum(k.cast("int") for k in kinds) >= 2)
    all_roles = F.size(F.array_intersect("_roles", F.array(*map(F.lit, ROLES)))) == len(ROLES)
    return all_of.select("hook", (_true(F.col("basic")) & _true(F.col("_fine")) & _true(all_roles) & _true(ordered) & _true(carried_on) & _true(backed)).alias("local"))


def categories(hooks: DataFrame, chains: DataFrame, valid: DataFrame, local: DataFrame) -> DataFrame:
    """hook, a_min, a_full, status, category of every hook.

    hooks: hook, route, gold, seeds, attrs (arrays of predicates). a_min: some attribution predicate's chain is valid; a_full: also all seeds' that were not disclosed (one at
    least). G: full, a causal route and gold; P: a_min and a valid route; L: no a_min but a local resolution; else F. Where predicates are repeated or are not just those of
    seeds and attrs, status is `invalid` and the rest null.
    """
    seen = chains.select("hook", "predicate", "disclosed").join(valid, ["hook", "predicate"]).groupBy("hook").agg(
        F.count("*").alias("_n"), F.collect_set("predicate").alias("_all"), F.collect_set(F.when(F.col("valid"), F.col("predicate"))).alias("_valid"), F.collect_set(F.when(~_true(F.col("disclosed")), F.col("predicate"))).alias("_open")
    )
    none = F.array().cast("array<string>")
    h = hooks.join(seen, "hook", "left").join(local.select("hook", "local"), "hook", "left")
    h = h.select("hook", "route", "gold", "seeds", "attrs", _true(F.col("local")).alias("local"), F.coalesce("_n", F.lit(0)).alias("n"), *[F.coalesce(c, none).alias(c[1:]) for c in ("_all", "_valid", "_open")])
    declared = F.array_sort(F.array_union("seeds", "attrs"))
    sound = (F.size("all") == F.col("n")) & (F.array_sort("all") == declared)
    eligible = F.array_intersect("seeds", "open")
    h = h.withColumn("a_min", F.arrays_overlap("attrs", "valid")).withColumn("_eligible", F.size(eligible)).withColumn("a_full", _true(F.col("a_min") & (F.size(eligible) > 0) & (F.size(F.array_except(eligible, "valid")) == 0)))
    status = F.when(~sound, "invalid").when(F.col("a_full"), "full").when(F.col("a_min"), "min").when(F.col("_eligible") == 0, "unidentifiable").otherwise("none")
    category = F.when(F.col("a_full") & F.col("route").isin(CAUSAL_ROUTES) & _true(F.col("gold")), "G").when(F.col("a_min") & F.col("route").isin(VALID_ROUTES), "P").when(~F.col("a_min") & F.col("local"), "L").otherwise("F")
    return h.select("hook", F.when(sound, F.col("a_min")).alias("a_min"), F.when(sound, F.col("a_full")).alias("a_full"), status.alias("status"), F.when(sound, category).alias("category"))
