"""Journeys: definitions and bindings, integrity issues, the nine closure dimensions, closures and rates.

A conversation is a journey and a turn a step with a binding. What the table doesn't have (criticality, status, kind and
evidence of a binding) follows from conv_id and turn by fixed rules, so that every branch of the rules occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import quoted
from ..sources.tables import table
from .shared import Base, define

#: Of a text only its beginning is asked for (see CLOSED), so no more of it is shuffled.
BEGINNING = len("unresolved product outcome")
TURNS = Base("turns", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", "role", F.substring("text", 1, BEGINNING).alias("text")), "turns AS (SELECT conv_id, turn, role, text FROM conversations)")
TYPES = ["page", "ui-element", "event", "handler", "state-transition", "effect", "request", "endpoint", "response", "feedback", "outcome"]
DIMENSIONS = ["entry", "action", "handler", "state", "request", "response", "feedback", "outcome", "branch-failure"]
OF = {"entry": ["page"], "action": ["ui-element", "event"], "handler": ["handler"], "state": ["effect", "state-transition"], "request": ["request", "endpoint"], "response": ["response"], "feedback": ["feedback"], "outcome": ["outcome"]}
one_of = lambda values, i: "CASE " + i + " " + " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in enumerate(values[:-1])) + f" ELSE {quoted(values[-1])} END"
JOURNEYS = f"""ordered AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::BIGINT AS place FROM turns),
  bindings AS (SELECT conv_id AS journey_id, conv_id * 1000 + turn AS binding_id, turn AS step_id, place, role, {one_of(TYPES, '(conv_id * 3 + turn * 5) % 11')} AS binding_type,
    CASE WHEN (conv_id * 7 + turn) % 9 < 6 THEN 'confirmed' WHEN (conv_id * 7 + turn) % 9 < 8 THEN 'candidate' ELSE 'conflicted' END AS status, ((conv_id + turn) % 3)::BIGINT AS evidence, (turn % 2)::BIGINT AS claims FROM ordered),
  definitions AS (SELECT conv_id AS journey_id, {one_of(['low', 'medium', 'high', 'critical'], 'conv_id % 4')} AS criticality, {one_of(['candidate', 'open', 'closed', 'blocked', 'open', 'invalidated'], 'conv_id % 6')} AS declared, conv_id % 3 = 0 AS user_action, conv_id % 5 <> 0 AS entry_grounded,
    conv_id % 2 = 0 AS feedback_grounded, conv_id % 2 = 0 OR conv_id % 3 = 0 AS feedback_defined, conv_id % 7 <> 0 AS outcome_grounded, min_by(text, turn) AS description, count_if(role = 'system')::BIGINT AS failure_branches, count_if(role = 'system' AND (conv_id + turn) % 4 <> 0)::BIGINT AS grounded_branches FROM ordered GROUP BY conv_id),
  grounded AS (SELECT *, status = 'confirmed' AND evidence + claims > 0 AS is_grounded FROM bindings)"""
has = lambda kinds, more="": f"bool_or(b.binding_type IN ({', '.join(map(quoted, kinds))}){more})"
FLAGS = ", ".join(f"coalesce({has(k)}, false) AS has_{d}, coalesce({has(k, ' AND b.is_grounded')}, false) AS ok_{d}, coalesce({has(k, chr(32) + 'AND b.status = ' + quoted('conflicted'))}, false) AS bad_{d}" for d, k in OF.items())
REQUIRED = {
    "entry": "true", "action": "critical OR user_action OR has_action", "handler": "critical OR user_action OR has_action OR has_handler", "state": "critical OR has_state", "request": "critical OR has_request", "response": "critical OR has_response OR has_request",
    "feedback": "critical OR has_feedback OR feedback_defined", "outcome": "true", "branch-failure": "critical OR failure_branches > 0",
}
CLOSED = {
    "entry": "entry_grounded OR ok_entry", "action": "ok_action", "handler": "ok_handler", "state": "ok_transition", "request": "ok_send AND ok_endpoint", "response": "ok_response", "feedback": "ok_feedback AND feedback_grounded",
    "outcome": "ok_outcome AND outcome_grounded AND NOT ~(coalesce(description, ''), '(?i)^unresolved product outcome')", "branch-failure": "failure_branches > 0 AND grounded_branches = failure_branches",
}
CLOSURE = f"""{JOURNEYS}, flags AS (SELECT d.journey_id, d.criticality, d.criticality = 'critical' AS critical, d.declared, d.user_action, d.entry_grounded, d.feedback_grounded, d.feedback_defined, d.outcome_grounded, d.description, d.failure_branches, d.grounded_branches, {FLAGS},
    coalesce({has(['state-transition'], ' AND b.is_grounded')}, false) AS ok_transition, coalesce({has(['request'], ' AND b.is_grounded')}, false) AS ok_send, coalesce({has(['endpoint'], ' AND b.is_grounded')}, false) AS ok_endpoint
    FROM definitions d LEFT JOIN grounded b ON d.journey_id = b.journey_id GROUP BY ALL),
  judged AS ({" UNION ALL ".join(f"SELECT journey_id, criticality, declared, {quoted(d)} AS dimension, {i} AS ord, {REQUIRED[d]} AS required, {CLOSED[d]} AS closed, {'bad_' + d if d in OF else 'false'} OR declared = 'blocked' AS blocked FROM flags" for i, d in enumerate(DIMENSIONS))}),
  dimensions AS (SELECT *, CASE WHEN NOT required THEN 'not-applicable' WHEN closed THEN 'closed' WHEN blocked THEN 'blocked' ELSE 'open' END AS status FROM judged)"""
ISSUES = f"""{JOURNEYS}, issues AS (SELECT journey_id, 'STEP_ORDER_NOT_CONTIGUOUS' AS code, step_id FROM bindings WHERE step_id <> place - 1 UNION ALL SELECT journey_id, 'STEP_ID_DUPLICATE', step_id FROM bindings GROUP BY journey_id, step_id HAVING count(*) > 1
    UNION ALL SELECT journey_id, 'RELATION_NEXT_REVERSES_ORDER', step_id FROM (SELECT journey_id, step_id, lag(step_id) OVER (PARTITION BY journey_id ORDER BY binding_id) AS before FROM bindings) r WHERE step_id < before
    UNION ALL SELECT d.journey_id, 'SUCCESS_OUTCOME_STEP_UNKNOWN', NULL FROM definitions d WHERE d.journey_id NOT IN (SELECT journey_id FROM bindings WHERE role = 'assistant'))"""
SUMMARY = f"""{CLOSURE}, faults AS (SELECT journey_id, count(*) AS faults FROM (SELECT journey_id FROM bindings WHERE step_id <> place - 1) i GROUP BY journey_id), totals AS (SELECT journey_id, criticality, declared, count_if(required)::BIGINT AS required, count_if(required AND status = 'closed')::BIGINT AS closed_required FROM dimensions GROUP BY ALL),
  closable AS (SELECT t.*, coalesce(f.faults, 0)::BIGINT AS integrity_issues, coalesce(f.faults, 0) = 0 AND required > 0 AND closed_required = required AS can_close FROM totals t LEFT JOIN faults f ON t.journey_id = f.journey_id),
  closures AS (SELECT *, CASE WHEN declared = 'closed' AND NOT can_close THEN 'open' WHEN declared IN ('invalidated', 'blocked') THEN declared WHEN integrity_issues > 0 THEN CASE WHEN declared = 'candidate' THEN 'candidate' ELSE 'open' END WHEN can_close THEN 'closed' WHEN declared = 'candidate' THEN 'candidate' ELSE 'open' END AS status,
    criticality <> 'critical' OR can_close AS gate_passed, CASE WHEN required > 0 THEN round(closed_required::DOUBLE / required, 6) ELSE 0.0::DOUBLE END AS closure_rate FROM closable)"""
define("journey_bindings", [TURNS], f"{JOURNEYS} SELECT journey_id, binding_id, step_id, place, binding_type, status, evidence, claims, is_grounded FROM grounded", "Every binding and whether it is confirmed with evidence or claims.")
define("journey_integrity", [TURNS], f"{ISSUES} SELECT journey_id, code, step_id FROM issues", "Issue rows of the journeys' steps: order, duplicates, reversed relations, outcomes without a step.")
define("journey_dimensions", [TURNS], f"{CLOSURE} SELECT journey_id, dimension, required, status FROM dimensions", "The nine closure dimensions of every journey: required or not, and their state.")
define("journey_reasons", [TURNS], f"""{CLOSURE}, open_ones AS (SELECT f.*, d.dimension FROM flags f JOIN dimensions d ON f.journey_id = d.journey_id WHERE d.status IN ('open', 'blocked'))
  {" UNION ALL ".join(f"SELECT journey_id, dimension, {quoted(code)} AS reason FROM open_ones WHERE dimension = {quoted(d)} AND {when}" for d, code, when in [('entry', 'ENTRY_NOT_GROUNDED', 'true'), ('action', 'ACTION_BINDING_MISSING', 'NOT ok_action'), ('handler', 'HANDLER_BINDING_MISSING', 'NOT ok_handler'), ('state', 'STATE_TRANSITION_BINDING_MISSING', 'NOT ok_transition'), ('request', 'REQUEST_BINDING_MISSING', 'NOT ok_send'), ('request', 'ENDPOINT_BINDING_MISSING', 'NOT ok_endpoint'), ('response', 'RESPONSE_BINDING_MISSING', 'NOT ok_response'), ('feedback', 'FEEDBACK_BINDING_MISSING', 'NOT ok_feedback'), ('feedback', 'FEEDBACK_SEMANTICS_MISSING', 'NOT feedback_grounded'), ('outcome', 'OUTCOME_BINDING_MISSING', 'NOT ok_outcome'), ('outcome', 'PRODUCT_OUTCOME_UNRESOLVED', 'NOT outcome_grounded'), ('branch-failure', 'FAILURE_BRANCH_MISSING', 'failure_branches = 0'), ('branch-failure', 'FAILURE_BRANCH_NOT_GROUNDED', 'true')])}""", "Why a required dimension isn't closed.")
define("journey_closures", [TURNS], f"{SUMMARY} SELECT journey_id, criticality, declared, status, can_close, gate_passed, required, closed_required, closure_rate, integrity_issues FROM closures", "The closure of every journey: state, gate and rate.")
define("journey_gap_issues", [TURNS], f"{SUMMARY} SELECT journey_id, CASE WHEN criticality = 'critical' THEN 'CRITICAL_JOURNEY_CLOSED_WITH_GAPS' ELSE 'JOURNEY_CLOSED_WITH_GAPS' END AS code FROM closures WHERE declared = 'closed' AND NOT can_close", "Journeys that are declared closed although a required dimension is open.")
define("journey_dimension_rates", [TURNS], f"{CLOSURE} SELECT dimension, count_if(required)::BIGINT AS required, count_if(required AND status = 'closed')::BIGINT AS closed, CASE WHEN count_if(required) > 0 THEN round(count_if(required AND status = 'closed')::DOUBLE / count_if(required), 6) ELSE 1.0::DOUBLE END AS closure_rate FROM dimensions GROUP BY dimension", "The rate of each dimension over all journeys; 1 where none requires it.")
define("journey_set", [TURNS], f"{SUMMARY} SELECT count(*)::BIGINT AS journeys, count_if(status = 'closed')::BIGINT AS closed, count_if(status = 'open')::BIGINT AS open, count_if(status = 'blocked')::BIGINT AS blocked, count_if(status = 'candidate')::BIGINT AS candidate, count_if(status = 'invalidated')::BIGINT AS invalidated, count_if(criticality = 'critical')::BIGINT AS critical, count_if(criticality = 'critical' AND status = 'closed')::BIGINT AS critical_closed, coalesce(bool_and(criticality <> 'critical' OR status = 'closed'), true) AS gate_passed, CASE WHEN count(*) > 0 THEN round(count_if(status = 'closed')::DOUBLE / count(*), 6) ELSE 0.0::DOUBLE END AS closure_rate FROM closures", "Counts, gate and rate of all journeys; 0 without journeys.")
define("journey_blocking_steps", [TURNS], f"""{CLOSURE}, step_dims AS (SELECT b.journey_id, b.step_id, bool_and(d.status = 'closed') AS all_closed FROM grounded b JOIN (SELECT * FROM (VALUES {', '.join(f"('{t}', '{d}')" for d, ts in OF.items() for t in ts)}) t(binding_type, dimension)) t ON b.binding_type = t.binding_type JOIN dimensions d ON d.journey_id = b.journey_id AND d.dimension = t.dimension AND d.required WHERE b.is_grounded GROUP BY b.journey_id, b.step_id)
  SELECT b.journey_id, count(DISTINCT b.step_id)::BIGINT AS blocking_steps, count(DISTINCT CASE WHEN b.is_grounded AND coalesce(s.all_closed, true) THEN b.step_id END)::BIGINT AS closed_blocking_steps FROM grounded b LEFT JOIN step_dims s ON b.journey_id = s.journey_id AND b.step_id = s.step_id WHERE b.role = 'user' GROUP BY b.journey_id""", "Blocking steps (a user's turns) and how many are grounded with all their required dimensions closed.")
define("journey_runtime_flow", [TURNS], f"""{JOURNEYS}, relations AS (SELECT journey_id, binding_id AS from_binding, lead(binding_id) OVER (PARTITION BY journey_id ORDER BY binding_id) AS to_binding, least(CASE status WHEN 'confirmed' THEN 1.0::DOUBLE WHEN 'candidate' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END, coalesce(lead(CASE status WHEN 'confirmed' THEN 1.0::DOUBLE WHEN 'candidate' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END) OVER (PARTITION BY journey_id ORDER BY binding_id), 0.0::DOUBLE)) AS confidence FROM bindings)
  SELECT r.journey_id, r.from_binding, r.to_binding, r.confidence, b.step_id AS from_step, c.step_id AS to_step FROM relations r JOIN bindings b ON r.from_binding = b.binding_id JOIN bindings c ON r.to_binding = c.binding_id""", "Transitions between the steps of a flow, with the lesser confidence of their ends; relations to unknown bindings drop out.")
define("journey_candidates", [TURNS], f"{JOURNEYS} SELECT journey_id, min_by(binding_id, place) AS entry_binding, count(*)::BIGINT AS steps, @set(binding_type) AS binding_types, max(place)::BIGINT AS last_order FROM bindings GROUP BY journey_id", "A candidate for each entry: its first binding, steps and kinds of binding.")
define("journey_manifest", [TURNS], f"{JOURNEYS}, d AS (SELECT journey_id, @sha(criticality || '|' || declared) AS definition_hash FROM definitions), b AS (SELECT journey_id, count(*)::BIGINT AS bindings, sum(evidence)::BIGINT AS evidence, sum(claims)::BIGINT AS claims FROM bindings GROUP BY journey_id) SELECT d.journey_id, definition_hash, coalesce(bindings, 0)::BIGINT AS bindings, coalesce(evidence, 0)::BIGINT AS evidence, coalesce(claims, 0)::BIGINT AS claims FROM d FULL OUTER JOIN b ON d.journey_id = b.journey_id", "The journey store's manifest: one definition against one set of bindings, with hashes and counts.")
