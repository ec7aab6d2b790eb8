"""The corpus view again as SQL text, written from the same specification as ``sources.corpus``."""

from __future__ import annotations

import re

#: name -> (what it needs, its body). ``with_parts`` puts together the ones a query names.
PARTS: dict[str, str] = {
    "files": r"""
  SELECT *, CASE root_id WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 ELSE 4 END AS root_ordinal,
    CASE WHEN NOT inaccessible THEN strlen(content) END AS size_bytes,
    CASE WHEN inaccessible THEN 'inaccessible' ELSE 'observed' END AS status,
    string_split(relative_path, '\')[-1] AS file_name,
    regexp_extract(string_split(relative_path, '\')[-1], '(\.[^.]+)$', 1) AS extension,
    len(string_split(relative_path, '\')) - 1 AS depth,
    replace(lower(relative_path), '\', chr(0)) AS path_sort_key,
    attribute_word IN (4128, 4194336) AS cloud,
    CASE attribute_word WHEN 32 THEN 'Archive' WHEN 33 THEN 'ReadOnly, Archive' WHEN 34 THEN 'Hidden, Archive' WHEN 4128 THEN 'Archive, Offline' WHEN 128 THEN 'Normal' ELSE attribute_word::VARCHAR END AS attributes,
    list_transform(string_split(relative_path, '\'), lambda x, i: {'folder': CASE WHEN i < len(string_split(relative_path, '\')) THEN 1 ELSE 0 END, 'folded': lower(x), 'raw': x}) AS walk
  FROM raw_files""",
    "raw_files": r"""
  SELECT 1 AS root_id, doc_id AS file_id, source || '\' || lang || '\' || name AS relative_path,
    CASE doc_id % 6 WHEN 0 THEN 32 WHEN 1 THEN 33 WHEN 2 THEN 34 WHEN 3 THEN 4128 WHEN 4 THEN 4194336 ELSE 128 END AS attribute_word,
    CASE WHEN doc_id % 13 <> 0 THEN '1' END AS volume_serial, CASE WHEN doc_id % 13 <> 0 THEN doc_id::VARCHAR END AS file_index,
    doc_id AS minutes, doc_id % 97 = 0 AS inaccessible, text AS content FROM named
  UNION ALL
  SELECT 2, doc_id + 1000000000, lang || '\' || name, 32,
    CASE WHEN doc_id % 10 <> 0 OR doc_id % 13 <> 0 THEN '1' END,
    CASE WHEN doc_id % 10 <> 0 THEN (doc_id + 1000000000)::VARCHAR WHEN doc_id % 13 <> 0 THEN doc_id::VARCHAR END,
    doc_id, false, text FROM named WHERE doc_id % 5 = 0
  UNION ALL
  SELECT 3, page_id + 2000000000, 'page_' || page_id || '.html', 32, '2', (page_id + 2000000000)::VARCHAR, page_id, false, html FROM pages
  UNION ALL
  SELECT 4, conv_id * 1000 + turn + 3000000000, role || '\c' || conv_id || '_' || turn || '.txt', 32, '2', (conv_id * 1000 + turn + 3000000000)::VARCHAR, turn, false, text FROM conversations""",
    "named": r"""
  SELECT *, CASE doc_id % 8 WHEN 0 THEN 'doc' || doc_id || '.md' WHEN 1 THEN 'doc' || doc_id || '.TXT' WHEN 2 THEN 'doc' || doc_id || '.log'
    WHEN 3 THEN 'doc' || doc_id WHEN 4 THEN 'doc' || doc_id || '.' WHEN 5 THEN '.doc' || doc_id WHEN 6 THEN 'doc' || doc_id || '.tar.gz' ELSE 'doc' || doc_id || '.txt' END AS name
  FROM documents""",
    "roots": r"""
  SELECT * FROM (VALUES (1, 'C:\Corpus\Docs', 1), (2, 'C:\Corpus\Mirror', 2), (3, 'D:\Web', 4), (4, 'D:\Chat', 3)) t(root_id, root_path, root_ordinal)""",
    "present": "SELECT *, upper(sha256(content)) AS sha256, CASE WHEN volume_serial IS NOT NULL AND file_index IS NOT NULL THEN volume_serial || ':' || file_index END AS physical_key FROM files WHERE NOT inaccessible AND root_id IN (1, 2)",
    "dup_sets": """
  SELECT sha256, max(size_bytes) AS size_bytes, count(*) AS location_count, count(DISTINCT root_id) AS root_count,
    CASE WHEN count(physical_key) = count(*) THEN count(DISTINCT physical_key) END AS physical_copy_count,
    CASE WHEN count(physical_key) = count(*) THEN count(*) - count(DISTINCT physical_key) END AS hard_link_alias_count,
    count(physical_key) = count(*) AS physical_identity_complete,
    CASE WHEN count(physical_key) = count(*) THEN (count(DISTINCT physical_key) - 1) * max(size_bytes) END AS reclaimable_bytes
  FROM present GROUP BY sha256 HAVING count(*) > 1""",
    # three runs
    "snap1": "SELECT f.* FROM files f WHERE root_id IN (1, 2) AND minutes % 17 <> 0",
    "later": """
  SELECT * REPLACE (CASE WHEN minutes % 11 = 0 THEN content || '!' ELSE content END AS content,
    CASE WHEN inaccessible THEN NULL WHEN minutes % 11 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes),
    CASE WHEN minutes % 11 = 0 THEN minutes + 60 ELSE minutes END AS mtime FROM files WHERE root_id IN (1, 2)""",
    "snap2": "SELECT * FROM later WHERE minutes % 19 <> 0",
    "snap3": "SELECT * FROM later WHERE root_id = 1",
    "state1": """
  SELECT file_id, root_id, relative_path, root_ordinal, path_sort_key, CASE WHEN inaccessible THEN 'inaccessible' ELSE 'present' END AS state, 10000000000000 + file_id AS obs, 1 AS run, 1 AS first_run, 1 AS changed_run,
    size_bytes, minutes AS mtime, attributes, volume_serial, file_index, CASE WHEN NOT inaccessible THEN upper(sha256(content)) END AS sha,
    CASE WHEN NOT inaccessible THEN 10000000000000 + file_id END AS content_obs, CASE WHEN NOT inaccessible THEN 1 END AS content_run, 'first_seen' AS kind, NULL::BIGINT AS supersedes FROM snap1""",
    "state2": "{fold state1 snap2 2 1,2}",
    "state3h": "{fold state2 snap3 3 1}",
    "state3": """
  SELECT s.* REPLACE (CASE WHEN s.state = 'present' AND n.file_id IS NOT NULL THEN upper(sha256(n.content)) ELSE s.sha END AS sha,
    CASE WHEN s.state = 'present' AND n.file_id IS NOT NULL THEN s.obs ELSE s.content_obs END AS content_obs,
    CASE WHEN s.state = 'present' AND n.file_id IS NOT NULL THEN 3 ELSE s.content_run END AS content_run) FROM state3h s LEFT JOIN snap3 n USING (file_id)""",
    "observations": """
  SELECT obs AS observation_id, 1 AS run_id, file_id, root_id, kind AS change_kind, supersedes AS supersedes_observation_id, size_bytes FROM state1
  UNION ALL SELECT obs, 2, file_id, root_id, kind, supersedes, size_bytes FROM state2 WHERE kind IS NOT NULL
  UNION ALL SELECT obs, 3, file_id, root_id, kind, supersedes, size_bytes FROM state3h WHERE kind IS NOT NULL""",
    # hashing
    "hashable": "SELECT *, {'o': root_ordinal, 's': path_sort_key, 'f': file_id} AS ord, {'r': root_id, 'w': walk, 'f': file_id} AS walked FROM files WHERE NOT inaccessible AND root_id = 1",
}


def _fold(old: str, new: str, run: str, roots: str) -> str:
    kind = f"""CASE WHEN n.file_id IS NULL THEN NULL WHEN o.obs IS NULL THEN 'first_seen' WHEN n.inaccessible AND o.state = 'inaccessible' THEN NULL WHEN n.inaccessible THEN 'inaccessible'
      WHEN o.state IN ('missing', 'unverified', 'inaccessible') THEN 'reappeared'
      WHEN o.size_bytes IS DISTINCT FROM n.size_bytes OR o.mtime IS DISTINCT FROM n.mtime OR coalesce(o.attributes, '') <> coalesce(n.attributes, '')
        OR coalesce(o.volume_serial <> n.volume_serial, false) OR coalesce(o.file_index <> n.file_index, false) THEN 'modified' END"""
    gone = f"n.file_id IS NULL AND o.root_id IN ({roots}) AND o.state IN ('present', 'inaccessible')"
    state = f"CASE WHEN n.file_id IS NOT NULL THEN CASE WHEN n.inaccessible THEN 'inaccessible' ELSE 'present' END WHEN {gone} THEN 'missing' ELSE o.state END"
    pick = lambda c, o="": f"CASE WHEN n.file_id IS NOT NULL THEN n.{c} ELSE o.{o or c} END AS {c}"
    return f"""
  SELECT coalesce(n.file_id, o.file_id) AS file_id, {pick("root_id")}, {pick("relative_path")}, {pick("root_ordinal")}, {pick("path_sort_key")}, {state} AS state,
    CASE WHEN {kind} IS NOT NULL THEN {run} * 10000000000000 + n.file_id ELSE o.obs END AS obs, CASE WHEN n.file_id IS NOT NULL OR ({gone}) THEN {run} ELSE o.run END AS run,
    coalesce(o.first_run, {run}) AS first_run, CASE WHEN o.state IS DISTINCT FROM {state} THEN {run} ELSE o.changed_run END AS changed_run,
    {pick("size_bytes")}, {pick("mtime")}, {pick("attributes")}, {pick("volume_serial")}, {pick("file_index")}, o.sha, o.content_obs, o.content_run, {kind} AS kind, o.obs AS supersedes
  FROM {old} o FULL OUTER JOIN {new} n ON o.file_id = n.file_id"""


def _hash(window: int, skip_cloud: bool) -> dict[str, str]:
    return {
        "cand_sizes": f"""
  SELECT size_bytes, count(*) AS members, size_bytes * (count(*) - 1) AS reclaim, row_number() OVER (ORDER BY size_bytes * (count(*) - 1) DESC, min(ord)) AS size_group_id
  FROM hashable WHERE NOT (cloud AND {skip_cloud}) GROUP BY size_bytes HAVING count(*) > 1""",
        "parts": f"""
  SELECT h.file_id, h.size_bytes, s.size_group_id, h.walked, upper(sha256(encode(h.content)[1:{window}])) AS partial_hash, h.content
  FROM hashable h JOIN cand_sizes s ON h.size_bytes = s.size_bytes WHERE NOT (h.cloud AND {skip_cloud})""",
        "buckets": f"""
  SELECT size_group_id, partial_hash, max(size_bytes) <= {window} AS covered, min({{'g': size_group_id, 'w': walked}}) AS first,
    row_number() OVER (ORDER BY min({{'g': size_group_id, 'w': walked}})) AS partial_group_id FROM parts GROUP BY size_group_id, partial_hash HAVING count(*) > 1""",
        "staged": """
  SELECT p.*, b.partial_group_id, CASE WHEN b.partial_group_id IS NULL THEN 'RuledOut' WHEN b.covered THEN 'ConfirmedDuplicate' ELSE 'NeedsFullHash' END AS partial_status,
    CASE WHEN NOT b.covered THEN upper(sha256(p.content)) END AS full_hash FROM parts p LEFT JOIN buckets b ON p.size_group_id = b.size_group_id AND p.partial_hash = b.partial_hash""",
        "groups": """
  SELECT *, row_number() OVER (ORDER BY stage, first) AS duplicate_group_id FROM (
    SELECT 0 AS stage, partial_group_id, NULL AS full_hash, first FROM buckets WHERE covered
    UNION ALL SELECT 1, partial_group_id, full_hash, min({'g': size_group_id, 'w': walked}) FROM staged WHERE full_hash IS NOT NULL GROUP BY partial_group_id, full_hash HAVING count(*) > 1)""",
        "selective": f"""
  SELECT h.file_id, h.size_bytes, s.size_group_id, s.partial_hash, s.partial_group_id, s.partial_status, s.full_hash,
    CASE WHEN h.cloud AND {skip_cloud} THEN 'SkippedCloudOnly' WHEN s.size_group_id IS NULL THEN 'UniqueBySize' WHEN s.partial_status = 'RuledOut' THEN 'RuledOutByPartialHash'
      WHEN g.duplicate_group_id IS NOT NULL THEN 'ConfirmedDuplicate' ELSE 'RuledOutByFullHash' END AS final_status, g.duplicate_group_id
  FROM hashable h LEFT JOIN staged s ON h.file_id = s.file_id LEFT JOIN groups g ON s.partial_group_id = g.partial_group_id AND s.full_hash IS NOT DISTINCT FROM g.full_hash""",
    }


def with_parts(sql: str, window: int = 65536, skip_cloud: bool = True) -> str:
    """``sql`` with a WITH clause of the parts it needs, in order."""
    parts = PARTS | _hash(window, skip_cloud)
    done: dict[str, str] = {}

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+[0-9]?h?\b", text):
            if name in parts and name not in done:
                body = parts[name]
                if m := re.fullmatch(r"\{fold (\S+) (\S+) (\S+) (\S+)\}", body):
                    body = _fold(*m.groups())
                if name in ("state1",):
                    body = body
                done[name] = ""  # names that stand in their own text
                need(body)
                del done[name]
                done[name] = body

    need(sql)
    if not done:
        return sql
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in done.items()) + "\n" + sql
