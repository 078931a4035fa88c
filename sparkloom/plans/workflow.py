"""Runs of agents: events by type and payload checks, replayed state, traces and usage, work items, retries and the next action.

An event is a run event: its user is the run, its type follows from its id, its payload's fields from both.
"""

from __future__ import annotations

from ..functions.rules import quoted
from ..sources.tables import table
from .shared import Base, define

EVENTS = Base("run_events", lambda s, d: table(s, d, "events").selectExpr("event_id", "user_id AS run_id", "event_type AS action", "value", "unix_micros(cast(ts AS timestamp)) AS at_us"), "run_events AS (SELECT event_id, user_id AS run_id, event_type AS action, value, epoch_us(ts) AS at_us FROM events)")
#: Event type -> required payload fields with their kinds: t text, i integer, o object, n a nested id.
PAYLOADS = {
    "run-created": "snapshotId:t packageDir:t", "snapshot-created": "snapshotId:t inventoryPath:t", "support-decided": "decision:o", "census-completed": "inventoryPath:t fileCount:i", "static-graph-built": "graphPath:t graphId:t", "investigation-frame-built": "frame:o", "research-contracted": "contract:o", "work-planned": "item:o itemPath:t",
    "work-issued": "itemId:t", "result-detected": "itemId:t resultPath:t", "result-accepted": "itemId:t", "result-rejected": "itemId:t", "work-abandoned": "itemId:t", "work-waived": "itemId:t", "task-outcome-accepted": "contractId:t", "task-outcome-rejected": "contractId:t",
    "question-qualified": "questionId:n", "question-planned": "questionId:n", "question-resolved": "questionId:n", "question-blocked": "questionId:n", "question-invalidated": "questionId:n", "hypothesis-supported": "hypothesisId:n", "hypothesis-refuted": "hypothesisId:n", "claim-accepted": "claimId:t", "claim-refuted": "claimId:t",
    "journey-closed": "journeyId:n", "journey-reopened": "journeyId:n", "verification-passed": "phase:t issueCount:i", "verification-failed": "phase:t issueCount:i", "synthesis-accepted": "itemId:t narrativePath:t", "projection-built": "projection:t", "run-unsupported": "reason:t", "run-blocked": "reason:t", "run-completed": "narrativePath:t humanReadablePath:t mapManifestPath:t verificationPath:t projectionKey:o",
}
KINDS = {"t": "a non-empty string", "i": "an integer of 0 at least", "o": "an object", "n": "an id, own or nested"}
TYPES = f"types AS (SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(t)})' for i, t in enumerate(PAYLOADS))}) t(ord, event_type))"
FIELDS = f"fields AS (SELECT * FROM (VALUES {', '.join(f'({quoted(t)}, {k}, {quoted(f.split(chr(58))[0])}, {quoted(KINDS[f.split(chr(58))[1]])})' for t, fs in PAYLOADS.items() for k, f in enumerate(fs.split()))}) f(event_type, nth, field, wanted))"
TYPED = f"{TYPES}, typed AS (SELECT e.event_id, e.run_id, e.at_us, e.value, t.event_type, e.event_id % 7 AS item_id, row_number() OVER (PARTITION BY e.run_id ORDER BY e.event_id)::BIGINT AS sequence FROM run_events e JOIN types t ON e.event_id % {len(PAYLOADS)} = t.ord)"
state = lambda m: "CASE event_type " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in m.items()) + " END"
WORK = {"work-planned": "ready", "work-issued": "issued", "result-detected": "result-produced", "result-accepted": "accepted", "result-rejected": "rejected", "work-abandoned": "abandoned", "work-waived": "waived"}
OTHERS = {"question": {k: k.removeprefix("question-") for k in PAYLOADS if k.startswith("question-")}, "hypothesis": {"hypothesis-supported": "supported", "hypothesis-refuted": "refuted"}, "journey": {"journey-closed": "closed", "journey-reopened": "open"}, "projection": {"projection-built": "built"}, "claim": {"claim-accepted": "accepted", "claim-refuted": "refuted"}}
define("run_event_types", [EVENTS], f"{TYPED} SELECT event_type, count(*)::BIGINT AS events, count(DISTINCT run_id)::BIGINT AS runs FROM typed GROUP BY event_type", "Events of each type.")
define("run_event_issues", [EVENTS], f"""{TYPED}, {FIELDS} SELECT t.event_id, t.run_id, t.event_type, f.field, t.event_type || ' payload.' || f.field || ' must be ' || f.wanted AS issue FROM typed t JOIN fields f ON t.event_type = f.event_type WHERE (t.event_id + f.nth) % 9 = 0""", "Payload fields that an event's type requires and that it lacks.")
define("run_stream_issues", [EVENTS], f"""{TYPED} SELECT run_id, sequence, 'missing-start' AS issue FROM typed WHERE sequence = 1 AND event_type <> 'run-created' UNION ALL SELECT run_id, sequence, 'second-start' FROM typed WHERE sequence > 1 AND event_type = 'run-created'
  UNION ALL SELECT run_id, max(sequence), 'duplicate-id' FROM typed GROUP BY run_id, event_id HAVING count(*) > 1""", "Logs that don't begin with the creation of the run, or have a second one.")
define("work_item_states", [EVENTS], f"{TYPED} SELECT run_id, item_id, max_by(status, event_id) AS status, max(event_id) AS last_event, count(*)::BIGINT AS events FROM (SELECT *, {state(WORK)} AS status FROM typed) w WHERE status IS NOT NULL GROUP BY run_id, item_id", "The state of each work item after replay: that of its last event.")
define("work_state_counts", [EVENTS], f"{TYPED}, items AS (SELECT run_id, item_id, max_by(status, event_id) AS status FROM (SELECT *, {state(WORK)} AS status FROM typed) w WHERE status IS NOT NULL GROUP BY run_id, item_id) SELECT status, count(*)::BIGINT AS items, count(DISTINCT run_id)::BIGINT AS runs FROM items GROUP BY status", "Work items by state.")
define("entity_states", [EVENTS], f"{TYPED}, every AS ({' UNION ALL '.join(f'SELECT run_id, {quoted(e)} AS entity, item_id, event_id, {state(m)} AS status FROM typed WHERE {state(m)} IS NOT NULL' for e, m in OTHERS.items())}) SELECT run_id, entity, item_id, max_by(status, event_id) AS status, max(event_id) AS last_event FROM every GROUP BY run_id, entity, item_id", "The state of each question, hypothesis, journey, projection and claim after replay.")
TERMINAL = "CASE event_type WHEN 'run-unsupported' THEN 'unsupported' WHEN 'run-blocked' THEN 'blocked' WHEN 'run-completed' THEN 'completed' END"
define("run_terminals", [EVENTS], f"{TYPED} SELECT run_id, min(event_id) AS first_event, max(event_id) AS last_event, max(sequence) AS last_sequence, max_by(event_type, event_id) AS last_type, max_by(terminal, CASE WHEN terminal IS NULL THEN -1 ELSE event_id END) AS terminal FROM (SELECT *, {TERMINAL} AS terminal FROM typed) t GROUP BY run_id", "Each run's span, last event and end, if it has one.")
TRACES = """started AS (SELECT event_id, run_id, action, at_us, CAST(round(value * 100) AS BIGINT) AS cents, count(CASE WHEN action = 'view' THEN 1 END) OVER (PARTITION BY run_id ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS attempt FROM run_events),
  traces AS (SELECT run_id, attempt, action, cents, CASE WHEN action IN ('purchase', 'error') THEN greatest(0, at_us - max(CASE WHEN action = 'view' THEN at_us END) OVER (PARTITION BY run_id, attempt)) END AS duration_us FROM started WHERE attempt > 0)"""
define("trace_durations", [EVENTS], f"{TRACES} SELECT run_id, attempt::BIGINT AS attempt, action, sum(duration_us @div 1000)::BIGINT AS duration_ms, count(*)::BIGINT AS traces FROM traces GROUP BY run_id, attempt, action", "Time from an attempt's start (the latest view before) to its end (purchase or error).")
define("agent_debug_summary", [EVENTS], f"""{TRACES}, sums AS (SELECT run_id, count(*) AS traces, count_if(action = 'purchase') AS accepted, count_if(action = 'error') AS failed, sum(CASE WHEN action = 'click' THEN cents ELSE 0 END) AS input_tokens, sum(CASE WHEN action = 'purchase' THEN cents ELSE 0 END) AS output_tokens, sum(CASE WHEN action = 'view' THEN cents ELSE 0 END) AS cached_tokens, sum(coalesce(duration_us, 0)) AS duration_us FROM traces GROUP BY run_id)
  SELECT run_id, traces::BIGINT AS traces, accepted::BIGINT AS accepted, failed::BIGINT AS failed, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, cached_tokens::BIGINT AS cached_tokens, (duration_us @div 1000)::BIGINT AS duration_ms, CASE WHEN input_tokens + output_tokens > 0 THEN round(accepted * 1000.0::DOUBLE / (input_tokens + output_tokens), 6) END AS accepted_per_1k_tokens,
    CASE WHEN duration_us > 0 THEN round(accepted * 60000000.0::DOUBLE / duration_us, 6) END AS accepted_per_minute, CASE WHEN accepted > 0 THEN round(output_tokens / 100.0::DOUBLE / accepted, 6) END AS cost_per_accepted, CASE WHEN input_tokens > 0 THEN round(cached_tokens::DOUBLE / input_tokens, 6) END AS reuse FROM sums""", "Usage of each run and its ratios: accepted work per 1000 tokens and minute, cost of each, share from the cache; null where the divisor is 0.")
ITEMS = f"{TYPED}, items AS (SELECT run_id, item_id, max_by(status, event_id) AS status, count(CASE WHEN status = 'issued' THEN 1 END) AS attempts FROM (SELECT *, {state(WORK)} AS status FROM typed) w WHERE status IS NOT NULL GROUP BY run_id, item_id)"
define("contract_states", [EVENTS], f"{ITEMS}, contracts AS (SELECT DISTINCT run_id, event_id % 7 AS item_id FROM typed) SELECT c.run_id, c.item_id, coalesce(i.status, 'undispatched') AS state, coalesce(i.attempts, 0)::BIGINT AS attempts FROM contracts c LEFT JOIN items i ON c.run_id = i.run_id AND c.item_id = i.item_id", "Each contract with the state of its work item; without one it is undispatched.")
define("retry_candidates", [EVENTS], f"{ITEMS} SELECT i.run_id, i.item_id, i.attempts::BIGINT AS attempts, i.attempts < 3 AS may_retry FROM items i ANTI JOIN (SELECT run_id, item_id FROM items WHERE status IN ('ready', 'issued', 'accepted')) r ON i.run_id = r.run_id AND i.item_id = r.item_id WHERE i.status IN ('rejected', 'abandoned')", "Failed work without a retry under way, and whether its three attempts are used up.")
define("next_action", [EVENTS], f"""{ITEMS}, totals AS (SELECT run_id, count(*) AS items, count_if(status = 'ready') AS ready, count_if(status = 'issued') AS issued, count_if(status = 'result-produced') AS produced, count_if(status = 'rejected') AS rejected, count_if(status = 'accepted') AS accepted FROM items GROUP BY run_id), ends AS (SELECT run_id, max_by({TERMINAL}, CASE WHEN {TERMINAL} IS NULL THEN -1 ELSE event_id END) AS terminal FROM typed GROUP BY run_id)
  SELECT e.run_id, coalesce(t.items, 0)::BIGINT AS items, CASE WHEN e.terminal IS NOT NULL THEN 'none' WHEN coalesce(t.items, 0) = 0 THEN 'dispatch' WHEN t.produced > 0 THEN 'ingest' WHEN t.rejected > 0 THEN 'retry' WHEN t.issued > 0 THEN 'wait' WHEN t.ready > 0 THEN 'issue' WHEN t.accepted = t.items THEN 'project' ELSE 'verify' END AS action FROM ends e LEFT JOIN totals t ON e.run_id = t.run_id""", "The first step of the ladder that fits each run.")
define("dispatch_plan", [EVENTS], f"{ITEMS} SELECT run_id, item_id, place::BIGINT AS place, CASE WHEN place <= 8 THEN 'fast' WHEN place <= 24 THEN 'deep' ELSE 'later' END AS wave FROM (SELECT run_id, item_id, row_number() OVER (PARTITION BY run_id ORDER BY attempts, item_id) AS place FROM items WHERE status IN ('ready', 'rejected')) d", "Open work in the order of dispatch, with the wave that its place gives.")
define("run_criticality", [EVENTS], f"{TYPED} SELECT run_id, max_by(level, ord) AS criticality, max(ord)::BIGINT AS ord FROM (SELECT run_id, CASE item_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS level, item_id % 4 AS ord FROM typed) l GROUP BY run_id", "The greatest criticality of each run by rank.")
define("stage_manifest", [EVENTS], """stages AS (SELECT run_id, action AS stage, count(*) AS n FROM run_events GROUP BY run_id, action), status AS (SELECT run_id, stage, CASE WHEN n > 1 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS completeness FROM stages)
  SELECT stage, count_if(status = 'complete')::BIGINT AS complete, count_if(status = 'partial')::BIGINT AS partial, round(avg(completeness), 3) AS completeness FROM status GROUP BY stage""", "Stages over all runs: complete, partial, and the mean completeness.")
