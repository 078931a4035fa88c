"""Catalogs and contracts: zones, node semantics, task outcomes and claims, each with its constraints as issue rows.

A repository's top directories are zones, the directory below a subzone; labels are a catalog's entries, documents what it has to cover.
"""

from __future__ import annotations

from ..functions.rules import quoted
from ..sources.repos import REPOS
from ..sources.tables import table
from .census import FILES
from .shared import Base, define

LABELS = Base("entries", lambda s, d: table(s, d, "labels").selectExpr("doc_id AS file_id", "quality", "toxic"), "entries AS (SELECT doc_id AS file_id, quality, toxic FROM labels)")
STATUS = "CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'needs-evidence' ELSE 'rejected' END"
ZONED = "zoned AS (SELECT file_id, repo, path, CASE WHEN ~(path, '/') THEN regexp_extract(path, '^([^/]+)/', 1) ELSE '.' END AS zone, coalesce(nullif(regexp_extract(path, '^([^/]+/[^/]+)/', 1), ''), '.') AS subzone, length(text)::BIGINT AS size FROM repo_files)"
LINES = "(1 + file_id % 11)"
SEMANTICS = f"""{ZONED}, semantics AS (SELECT e.file_id, z.repo, z.path, z.zone, {STATUS} AS status, 'evidence:file:' || CASE WHEN e.file_id % 13 = 0 THEN 'missing/' ELSE '' END || z.path AS evidence_ref, (e.file_id % 5)::BIGINT AS start_line, ((e.file_id * 3) % 17)::BIGINT AS end_line, z.size @div 80 + 1 AS lines, CASE WHEN e.file_id % 19 = 0 THEN 1.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM entries e JOIN zoned z ON e.file_id = z.file_id)"""
define("zone_memberships", [FILES], f"{ZONED} SELECT repo, file_id, zone, subzone, 'zone:' || repo || '/' || zone AS zone_id FROM zoned", "The zone and subzone of every file.")
define("zone_summaries", [FILES], f"{ZONED} SELECT repo, zone, count(*)::BIGINT AS files, count(DISTINCT subzone)::BIGINT AS subzones, sum(size)::BIGINT AS size, @set(subzone) AS subzone_list FROM zoned GROUP BY repo, zone", "Zones with their files and subzones.")
define("zone_catalog_issues", [FILES, LABELS], f"""{ZONED}, members AS (SELECT z.repo, z.file_id, z.zone, z.subzone, z.path FROM zoned z JOIN entries e ON z.file_id = e.file_id)
  SELECT repo, 'membership-missing' AS issue, 'file:' || file_id AS subject FROM zoned z ANTI JOIN entries e ON z.file_id = e.file_id UNION ALL SELECT z.repo, 'membership-duplicate', 'file:' || z.file_id FROM members z GROUP BY z.repo, z.file_id HAVING count(*) > 1
  UNION ALL SELECT repo, 'zones-exceed-limit', 'repo:' || repo FROM zoned GROUP BY repo HAVING count(DISTINCT zone) > 24 UNION ALL SELECT repo, 'subzones-exceed-limit', 'repo:' || repo FROM zoned GROUP BY repo HAVING count(DISTINCT subzone) > 96
  UNION ALL SELECT repo, 'zone-empty', 'zone:' || zone FROM (SELECT z.repo, z.zone, count(m.file_id) AS n FROM zoned z LEFT JOIN members m ON z.file_id = m.file_id GROUP BY z.repo, z.zone) c WHERE n = 0""", "What keeps a zone catalog from covering each file exactly once, within its limits and with no empty zone.")
define("zone_reviews", [FILES, LABELS], f"""{ZONED}, r AS (SELECT z.repo, z.zone, count(*) AS files, count(e.file_id) AS reviewed, count_if(e.quality = 1) AS good, bool_or(coalesce(e.toxic, 0) = 1) AS unsafe FROM zoned z LEFT JOIN entries e ON z.file_id = e.file_id GROUP BY z.repo, z.zone)
  SELECT repo, zone, files = reviewed AS covers, reviewed > 0 AS has_review, good * 2 >= reviewed AS coherent, NOT unsafe AS safe, CASE WHEN files = reviewed AND good * 2 >= reviewed AND NOT unsafe THEN 'accepted' WHEN reviewed = 0 THEN 'missing' ELSE 'changes-requested' END AS verdict FROM r""", "The checks of each zone's review and the verdict that they give.")
define("zone_agent_context", [FILES, LABELS], f"""{ZONED}, near AS (SELECT repo, zone, count(DISTINCT path) AS peers FROM zoned GROUP BY repo, zone)
  SELECT z.repo, z.zone, count(*)::BIGINT AS files, count(e.file_id)::BIGINT AS with_semantics, max(n.peers)::BIGINT AS distinct_paths, coalesce(min(e.file_id), -1) AS first_known FROM zoned z LEFT JOIN entries e ON z.file_id = e.file_id LEFT JOIN near n ON z.repo = n.repo AND z.zone = n.zone GROUP BY z.repo, z.zone""", "What an agent is told of each zone: its files, what is known of them, and its paths.")
define("semantic_catalog_issues", [FILES, LABELS], f"""{SEMANTICS}, known AS (SELECT DISTINCT 'evidence:file:' || path AS ref FROM zoned) SELECT file_id, 'evidence-unknown' AS issue FROM semantics s ANTI JOIN known k ON s.evidence_ref = k.ref UNION ALL SELECT file_id, 'line-range-reversed' FROM semantics WHERE end_line < start_line
  UNION ALL SELECT file_id, 'line-beyond-file' FROM semantics WHERE end_line > lines UNION ALL SELECT file_id, 'confidence-out-of-range' FROM semantics WHERE confidence < 0 OR confidence > 1 UNION ALL SELECT file_id, 'entry-duplicate' FROM semantics GROUP BY file_id HAVING count(*) > 1
  UNION ALL SELECT e.file_id, 'file-unknown' FROM entries e ANTI JOIN zoned z ON e.file_id = z.file_id""", "Catalog entries whose evidence, lines, confidence or identity don't hold.")
define("semantic_coverage", [FILES, LABELS], f"""{SEMANTICS}, eligible AS (SELECT repo, file_id FROM zoned WHERE ~(path, '(?i)[.](?:[cm]?[jt]s|[jt]sx|svelte|vue)$')), done AS (SELECT DISTINCT file_id FROM semantics WHERE status = 'accepted')
  SELECT e.repo, count(*)::BIGINT AS expected, count(d.file_id)::BIGINT AS accepted, (count(*) - count(d.file_id))::BIGINT AS missing, round(count(d.file_id)::DOUBLE / count(*), 6) AS ratio FROM eligible e LEFT JOIN done d ON e.file_id = d.file_id GROUP BY e.repo""", "Files that may have semantics against those that have accepted ones.")
define("semantic_missing", [FILES, LABELS], f"""{SEMANTICS}, eligible AS (SELECT repo, file_id FROM zoned WHERE ~(path, '(?i)[.](?:[cm]?[jt]s|[jt]sx|svelte|vue)$')) SELECT e.repo, e.file_id FROM eligible e ANTI JOIN (SELECT file_id FROM semantics WHERE status = 'accepted') d ON e.file_id = d.file_id""", "Files that still lack accepted semantics.")
BATCHES = f"{SEMANTICS}, batches AS (SELECT repo, file_id, 'batch:' || repo || ':' || (row_number() OVER (PARTITION BY repo ORDER BY path, file_id) - 1) @div 8 AS batch_id FROM zoned)"
define("semantic_ingest", [FILES, LABELS], f"""{BATCHES}, results AS (SELECT b.batch_id, count(*) AS files, count(s.file_id) AS entries, count_if(s.confidence > 1) AS invalid, count_if(s.status = 'rejected') AS rejected, count_if(s.status = 'needs-evidence') AS unreviewed FROM batches b LEFT JOIN semantics s ON b.file_id = s.file_id GROUP BY b.batch_id)
  SELECT batch_id, files::BIGINT AS files, entries::BIGINT AS entries, CASE WHEN entries = 0 THEN 'missing' WHEN unreviewed > 0 THEN 'unreviewed' WHEN invalid > 0 THEN 'invalid' WHEN rejected > 0 THEN 'changes-requested' ELSE 'accepted' END AS state FROM results""", "The state of each batch: its results and their reviews by a ladder.")
define("batch_cover_issues", [FILES, LABELS], f"""{BATCHES} SELECT batch_id, 'files-exceed-limit' AS issue, count(*)::BIGINT AS n FROM batches GROUP BY batch_id HAVING count(*) > 8 UNION ALL SELECT min(batch_id), 'file-repeated', count(*)::BIGINT FROM batches GROUP BY file_id HAVING count(*) > 1
  UNION ALL SELECT b.batch_id, 'entries-missing', count(*)::BIGINT FROM batches b ANTI JOIN semantics s ON b.file_id = s.file_id GROUP BY b.batch_id""", "Batches beyond their limit, files in two of them, and files without an entry.")
QUESTIONS = f"""asked AS (SELECT file_id AS question_id, 'repo' || (file_id % {REPOS}) AS contract_id, file_id % 4 = 0 AS critical, 1 + file_id % 3 AS minimum FROM repo_files), answered AS (SELECT file_id AS question_id, 'repo' || ((file_id + CASE WHEN file_id % 23 = 0 THEN 1 ELSE 0 END) % {REPOS}) AS contract_id, CASE quality WHEN 1 THEN 'resolved' ELSE 'blocked' END AS status, (file_id % 4)::BIGINT AS evidence, toxic FROM entries)"""
define("question_alignment", [FILES, LABELS], f"""{QUESTIONS} SELECT coalesce(a.question_id, b.question_id) AS question_id, CASE WHEN b.question_id IS NULL THEN 'QUESTION_OUTCOME_MISSING' WHEN a.question_id IS NULL THEN 'QUESTION_UNKNOWN' WHEN a.contract_id <> b.contract_id THEN 'QUESTION_FIELD_DRIFT' WHEN b.status = 'resolved' AND b.evidence = 0 THEN 'RESOLVED_WITHOUT_EVIDENCE' END AS issue
  FROM asked a FULL OUTER JOIN answered b ON a.question_id = b.question_id WHERE b.question_id IS NULL OR a.question_id IS NULL OR a.contract_id <> b.contract_id OR (b.status = 'resolved' AND b.evidence = 0)""", "A contract's questions against an outcome's: missing, unknown, drifting, and resolved without evidence.")
define("acceptance_criteria", [FILES, LABELS], f"{QUESTIONS} SELECT a.contract_id, a.question_id, a.minimum::BIGINT AS minimum, coalesce(b.evidence, 0)::BIGINT AS evidence, coalesce(b.evidence, 0) >= a.minimum AS met FROM asked a LEFT JOIN answered b ON a.question_id = b.question_id", "Each criterion's evidence against its minimum.")
define("task_completion", [FILES, LABELS], f"""{QUESTIONS}, c AS (SELECT a.contract_id, count(*) AS questions, count_if(coalesce(b.status, '') <> 'resolved') AS unresolved, count_if(a.critical AND coalesce(b.status, '') <> 'resolved') AS critical_unresolved, bool_and(coalesce(b.evidence, 0) >= a.minimum) AS criteria_met, count_if(coalesce(b.toxic, 0) = 1) AS follow_ups FROM asked a LEFT JOIN answered b ON a.question_id = b.question_id GROUP BY a.contract_id)
  SELECT contract_id, questions::BIGINT AS questions, unresolved::BIGINT AS unresolved, criteria_met, follow_ups::BIGINT AS follow_ups, CASE WHEN critical_unresolved > 0 THEN 'blocked' WHEN unresolved > 0 THEN 'partial' WHEN criteria_met THEN 'complete' ELSE 'needs-evidence' END AS status FROM c""", "Whether each contract's outcome completes it.")
define("acceptance_events", [FILES, LABELS], f"""{QUESTIONS}, c AS (SELECT a.contract_id, count_if(a.critical AND coalesce(b.status, '') <> 'resolved') AS bad FROM asked a LEFT JOIN answered b ON a.question_id = b.question_id GROUP BY a.contract_id) SELECT contract_id, CASE WHEN bad = 0 THEN 'task-outcome-accepted' ELSE 'task-outcome-rejected' END AS event_type, NULL::BIGINT AS question_id FROM c
  UNION ALL SELECT a.contract_id, 'question-' || b.status, a.question_id FROM asked a JOIN answered b ON a.question_id = b.question_id""", "The events that accepting an outcome writes: one for the outcome and one for each question.")
define("scope_violations", [FILES, LABELS], f"""{QUESTIONS}, allowed AS (SELECT contract_id, question_id FROM asked) SELECT b.contract_id, b.question_id FROM answered b ANTI JOIN allowed a ON a.contract_id = b.contract_id AND a.question_id = b.question_id""", "Answers outside the scope of their contract.")
define("follow_up_issues", [FILES, LABELS], f"""{QUESTIONS}, follow AS (SELECT question_id, 'open-question' AS category FROM answered WHERE status = 'blocked' UNION ALL SELECT question_id, 'diagnostic' FROM answered WHERE toxic = 1) SELECT question_id, count(DISTINCT category)::BIGINT AS categories, 'ID_IN_SEVERAL_CATEGORIES' AS issue FROM follow GROUP BY question_id HAVING count(DISTINCT category) > 1""", "Follow-ups that are filed under more than one category.")
define("duplicate_key_issues", [FILES, LABELS], "SELECT file_id, count(*)::BIGINT AS n, 'DUPLICATE_ID' AS issue FROM entries GROUP BY file_id HAVING count(*) > 1 UNION ALL SELECT file_id, 1::BIGINT, 'ID_MISSING' FROM entries WHERE file_id IS NULL", "Entries whose key isn't one of its own.")
CLAIMS = f"""claims AS (SELECT 'claim:' || file_id AS claim_id, file_id, 'file:' || file_id AS subject, CASE WHEN file_id % 3 = 0 THEN 'owns-route' WHEN file_id % 3 = 1 THEN 'implements-goal' ELSE 'has-role' END AS predicate, {STATUS} AS status, CASE WHEN file_id % 4 = 0 THEN 'agent' ELSE 'static' END AS derivation, CASE WHEN toxic = 1 THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM entries)"""
define("semantic_store", [FILES, LABELS], f"{CLAIMS}, evidence AS (SELECT DISTINCT 'evidence:file:' || path AS evidence_id, path FROM repo_files) SELECT 'claims' AS part, count(*)::BIGINT AS rows, count_if(status = 'accepted')::BIGINT AS accepted FROM claims UNION ALL SELECT 'evidence', count(*)::BIGINT, count(*)::BIGINT FROM evidence", "The semantic store's manifest: its parts and how many of their rows count.")
define("accepted_claims", [FILES, LABELS], f"{CLAIMS} SELECT claim_id, subject, predicate, confidence, derivation, predicate IN ('owns-route', 'has-role') AS application, predicate = 'implements-goal' AS experience FROM claims WHERE status = 'accepted'", "Accepted claims, and which map each belongs to.")
define("claim_evidence_issues", [FILES, LABELS], f"{CLAIMS} SELECT c.claim_id, 'EVIDENCE_UNKNOWN' AS issue FROM claims c ANTI JOIN repo_files f ON c.file_id = f.file_id UNION ALL SELECT claim_id, 'CLAIM_DUPLICATE' FROM claims GROUP BY claim_id HAVING count(*) > 1", "Claims whose evidence doesn't exist, or that are there twice.")
define("narrative_limitations", [FILES, LABELS], f"{QUESTIONS}, open_ones AS (SELECT a.question_id FROM asked a LEFT JOIN answered b ON a.question_id = b.question_id WHERE coalesce(b.status, '') <> 'resolved'), named AS (SELECT question_id FROM answered WHERE status = 'blocked') SELECT o.question_id, 'LIMITATION_MISSING' AS issue FROM open_ones o ANTI JOIN named n ON o.question_id = n.question_id", "Open questions that the narrative doesn't name among its limitations.")
define("agent_analysis_issues", [LABELS], """analyses AS (SELECT file_id, CASE WHEN file_id % 6 = 0 THEN '' ELSE 'agent' END AS produced_by, CASE WHEN quality = 1 THEN 'evidence:1' ELSE NULL END AS evidence, CASE WHEN toxic = 1 THEN NULL ELSE 'claim' END AS claim, CASE WHEN file_id % 10 = 0 THEN 'maybe' ELSE 'high' END AS confidence FROM entries)
  SELECT file_id, 'producedBy' AS field, 'must be agent' AS issue FROM analyses WHERE produced_by <> 'agent' UNION ALL SELECT file_id, 'evidenceRefs', 'must be a non-empty array' FROM analyses WHERE evidence IS NULL UNION ALL SELECT file_id, 'claim', 'is required' FROM analyses WHERE claim IS NULL UNION ALL SELECT file_id, 'confidence', 'must be low, medium or high' FROM analyses WHERE confidence NOT IN ('low', 'medium', 'high')""", "Analyses of agents whose required fields or enumerations don't hold.")
RESEARCH = f"""candidates AS (SELECT file_id, repo, path, CASE WHEN ~(text, '(?i)\\b(?:parse|syntax|unresolved import|alias)') THEN 'deterministic' WHEN ~(text, '(?i)TODO|FIXME') THEN 'static-gap' ELSE 'semantic' END AS class, CASE WHEN ~(path, '(?i)(^|/)(?:pages|views|app)/') THEN 'experience' WHEN ~(path, '(?i)(^|/)(?:api|server|services)/') THEN 'runtime' ELSE 'application' END AS dimension FROM repo_files)"""
define("question_classes", [FILES], f"{RESEARCH} SELECT repo, class, dimension, count(*)::BIGINT AS candidates FROM candidates GROUP BY repo, class, dimension", "Candidate questions by class and map dimension.")
define("open_questions", [FILES], f"{RESEARCH} SELECT 'question:' || file_id AS question_id, repo, dimension, 'evidence:file:' || path AS evidence_ref FROM candidates WHERE class = 'semantic'", "The semantic ones are questions.")
define("research_diagnostics", [FILES], f"{RESEARCH} SELECT 'diagnostic:' || file_id AS diagnostic_id, repo, class AS kind, CASE class WHEN 'deterministic' THEN 'error' ELSE 'warning' END AS severity, path FROM candidates WHERE class <> 'semantic'", "All others are diagnostics.")
define("research_contracts", [FILES], f"""{RESEARCH}, placed AS (SELECT *, row_number() OVER (PARTITION BY repo, dimension ORDER BY path, file_id) AS place FROM candidates WHERE class = 'semantic') SELECT 'contract:' || repo || ':' || dimension || ':' || (place - 1) @div 12 AS contract_id, repo, dimension, count(*)::BIGINT AS questions, count(DISTINCT path)::BIGINT AS allowed_files, min(path) AS first_file FROM placed GROUP BY repo, dimension, (place - 1) @div 12""", "Contracts of up to twelve questions of one repository and dimension, with their scope.")
define("latest_metrics", [FILES, LABELS], f"""{CLAIMS} SELECT 'files' AS metric, count(*)::BIGINT AS value FROM repo_files UNION ALL SELECT 'claims', count(*)::BIGINT FROM claims UNION ALL SELECT 'claims-' || status, count(*)::BIGINT FROM claims GROUP BY status""", "Counts of the stores by name.")
