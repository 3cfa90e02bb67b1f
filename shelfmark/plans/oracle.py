"""The same questions in DuckDB SQL, written from the rules and not from the Spark code.

`CTES` holds named sub-queries; `_sql` puts those a statement needs in front of it.
"""

from __future__ import annotations

import re

from shelfmark.functions import identity, names
from shelfmark.plans.views import VIEWS, duckdb_view

NOW = 1_800_000_000


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _case(text: str, values, fold=str) -> str:
    arms = " ".join(f"WHEN contains({text}, '{fold(v)}') THEN '{v}'" for v in values)
    return f"CASE {arms} END"


def _has(text: str, marks) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


def _stem(path: str) -> str:
    base = f"regexp_extract(rtrim({path}, '/'), '[^/]*$')"
    return f"regexp_replace(regexp_replace({base}, '\\.gguf$', ''), '\\.safetensors$', '')"


_SHARD = "-[0-9]{1,5}-of-[0-9]{1,5}(-[^/]*)?$"


def _slug(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


def _display(stem: str) -> str:
    text = f"lower(regexp_replace({stem}, '{_SHARD}', ''))"
    tag = _case(f"upper({text})", names.QUANT_TAGS)
    text = f"replace({text}, lower(coalesce({tag}, '##none##')), '')"
    for publisher in names.PUBLISHERS:
        text = f"replace({text}, '{publisher.lower()}', '')"
    pattern = "(^|[^a-z0-9])(ud|a[0-9]+b)($|[^a-z0-9])"
    return _slug(f"regexp_replace({text}, '{pattern}', '-', 'g')")


def _role(stem: str) -> str:
    low = f"lower({stem})"
    return f"""CASE WHEN {_has(low, names.MMPROJ_MARKS)} THEN 'mmproj'
      WHEN {_has(low, names.TOKENIZER_MARKS)} THEN 'tokenizer'
      WHEN {low} IN ({_quoted(names.CONFIG_STEMS)}) THEN 'config'
      WHEN ends_with({low}, '.lora') OR contains({low}, '-lora') THEN 'lora'
      WHEN regexp_matches({stem}, '{_SHARD}') THEN 'shard'
      WHEN {_has(low, names.SIDECAR_MARKS)} THEN 'sidecar' ELSE 'weights' END"""


def _kind_of_name(stem: str) -> str:
    low = f"lower({stem})"
    return f"""CASE WHEN {_has(low, names.RERANK_MARKS)} THEN 'rerank'
      WHEN {_has(low, names.EMBEDDING_MARKS)} THEN 'embeddings'
      WHEN {_has(low, names.AUDIO_MARKS)} THEN 'audio' END"""


def _round1(v: str) -> str:
    r = f"(round(({v}) * 10) / 10)"
    return (
        f"CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) "
        f"WHEN {r} IS NOT NULL THEN printf('%.1f', {r}) END"
    )


def _key(name: str, arch: str, total: str, active: str) -> str:
    return (
        f"concat({_slug(name)}, '|', coalesce({arch}, 'unk'), '|t', coalesce({_round1(total)}, 'unk'), "
        f"'|a', coalesce({_round1(active)}, 'unk'))"
    )


def _quant_of_number(n: str) -> str:
    arms = " ".join(f"WHEN {k} THEN '{q}'" for k, q in identity.FILE_TYPE_QUANTS.items())
    return f"CASE {n} {arms} END"


def _source(level: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in identity.LEVEL_SOURCES.items())
    return f"CASE {level} {arms} END"


def _tokens(key: str) -> str:
    return (
        f"list_filter(string_split(lower(split_part({key}, '|', 1)), '-'), lambda t: t <> '' AND "
        f"t NOT IN ({_quoted(names.STOP_TOKENS)}) AND NOT regexp_matches(t, '^[0-9]+\\.?[0-9]*b$'))"
    )


_GGUF_KIND = f"CASE WHEN {_has('arch', identity.VISION_MARKS)} THEN 'vision' ELSE 'llm' END"
_ST_KIND = (
    f"CASE WHEN {_has('lower(arch)', identity.VISION_MARKS)} THEN 'vision' "
    f"WHEN {_has('lower(arch)', identity.TEXT_MODEL_MARKS)} THEN 'llm' END"
)
_VARIANT = "concat_ws('#', family_key, rev_label, format, quant, subflavour, publisher)"

CTES = {name: duckdb_view(name) for name in VIEWS} | {
    "named": f"""SELECT *, {_role('stem')} AS role,
      {_case('upper(stem)', names.QUANT_TAGS)} AS name_quant,
      {_case('lower(stem)', names.PUBLISHERS, str.lower)} AS name_publisher,
      {_case('lower(stem)', names.SUBFLAVOURS)} AS name_subflavour,
      {_kind_of_name('stem')} AS name_kind, {_display('stem')} AS display
    FROM (SELECT *, {_stem('rel_path')} AS stem FROM v_files)""",
    "ident0": f"""SELECT *, {_quant_of_number('file_type')} AS header_quant,
      coalesce(basename, general_name) AS header_name,
      CASE WHEN arch IS NULL THEN NULL WHEN format = 'gguf' THEN {_GGUF_KIND} ELSE {_ST_KIND} END
        AS header_kind
    FROM named WHERE parse_state = 'ok'""",
    "ident1": """SELECT *,
      CASE WHEN role = 'shard' OR header_name IS NULL THEN display ELSE header_name END AS name,
      CASE WHEN role = 'shard' OR header_name IS NULL THEN 'inferred' ELSE 'known' END AS name_level,
      coalesce(header_quant, name_quant, 'unknown') AS quant,
      CASE WHEN header_quant IS NOT NULL THEN 'known' ELSE 'inferred' END AS quant_level,
      coalesce(CAST(file_type AS VARCHAR), name_quant) AS quant_raw,
      CASE WHEN file_type IS NOT NULL THEN 'known' WHEN name_quant IS NOT NULL THEN 'inferred' END
        AS quant_raw_level,
      coalesce(header_kind, name_kind, 'unknown') AS kind,
      CASE WHEN header_kind IS NOT NULL THEN CASE WHEN format = 'gguf' THEN 'known' ELSE 'inferred' END
           WHEN name_kind IS NOT NULL THEN 'inferred' ELSE 'detected' END AS kind_level,
      coalesce(name_subflavour, 'unknown') AS subflavour,
      coalesce(name_publisher, 'unknown') AS publisher,
      header_name IS NULL AND arch IS NULL AND params_total IS NULL
        AND role IN ('weights', 'shard') AND name_quant IS NULL AS is_unknown
    FROM ident0""",
    "ident": f"""SELECT *, CASE WHEN NOT is_unknown THEN {_key('name', 'arch',
      "CASE WHEN role <> 'shard' THEN params_total END",
      "CASE WHEN role <> 'shard' THEN params_active END")} END AS family_key,
      CASE WHEN hash_state = 'full' AND sha256 IS NOT NULL THEN concat('local:', sha256)
           ELSE 'local:none' END AS rev_label
    FROM ident1""",
    "models": "SELECT * FROM ident WHERE role IN ('weights', 'shard') AND NOT is_unknown",
    "families": """SELECT family_key, name, arch, params_total, params_active, context_len, kind,
      root_id AS first_root_id, rel_path AS first_rel_path, '1' AS algo_version
    FROM (SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY root_id, rel_path) AS n
          FROM models) WHERE n = 1""",
    "variants": """SELECT family_key, rev_label, format, quant, subflavour, publisher, quant_raw
    FROM (SELECT *, row_number() OVER (PARTITION BY family_key, rev_label, format, quant, subflavour,
            publisher ORDER BY root_id, rel_path) AS n FROM models) WHERE n = 1""",
    "roles": """SELECT * FROM (
      SELECT root_id, rel_path, role, family_key, rev_label, format, quant, subflavour, publisher FROM models
      UNION ALL
      SELECT root_id, rel_path, role, CASE WHEN family_key IN (SELECT family_key FROM families)
        THEN family_key END, NULL, NULL, NULL, NULL, NULL
      FROM ident WHERE role NOT IN ('weights', 'shard'))
    WHERE (root_id, rel_path) NOT IN (SELECT (root_id, rel_path) FROM v_files WHERE state = 'missing')""",
    "facts0": f"""
      SELECT root_id, rel_path, 'family' AS subject_type, family_key AS subject_key, 'name' AS field,
        name AS value, name_level AS level, {_source('name_level')} AS source FROM models
      WHERE arch IS NOT NULL OR params_total IS NOT NULL OR context_len IS NOT NULL
      UNION ALL SELECT root_id, rel_path, 'family', family_key, 'arch', arch, 'known', 'content'
      FROM models WHERE arch IS NOT NULL
      UNION ALL SELECT root_id, rel_path, 'family', family_key, 'params_total', {_round1('params_total')},
        'known', 'content' FROM models WHERE params_total IS NOT NULL
      UNION ALL SELECT root_id, rel_path, 'family', family_key, 'kind', kind, kind_level,
        {_source('name_level')} FROM models
      UNION ALL SELECT root_id, rel_path, 'variant', {_VARIANT}, 'quant', quant, quant_level,
        {_source('quant_level')} FROM models
      UNION ALL SELECT root_id, rel_path, 'variant', {_VARIANT}, 'publisher', publisher, 'inferred',
        'filename' FROM models
      UNION ALL SELECT root_id, rel_path, 'variant', {_VARIANT}, 'subflavour', subflavour, 'inferred',
        'filename' FROM models
      UNION ALL SELECT root_id, rel_path, 'file', concat(root_id, ':', rel_path), 'role', role,
        'inferred', 'filename' FROM ident WHERE role NOT IN ('weights', 'shard')""",
    "facts": """SELECT subject_type, subject_key, field, value, level, source,
      max((root_id, rel_path)) AS last_at
    FROM facts0 WHERE value <> '' GROUP BY ALL""",
    "logged": f"""SELECT CAST(regexp_extract(struct_extract(last_at, 2), '^p([0-9]+)/', 1) AS BIGINT) AS seq,
      subject_type, subject_key, field, value, level, source, CAST({NOW} AS BIGINT) AS recorded_at
    FROM facts""",
    "groups": """SELECT sha256, max(size) AS size, CAST(sum(n) AS BIGINT) AS copies,
      count(*) AS allocations FROM
      (SELECT sha256, dev, ino, count(*) AS n, max(size) AS size FROM v_docs
       WHERE hash_state = 'full' AND state = 'present' GROUP BY ALL)
    GROUP BY sha256 HAVING sum(n) > 1""",
    "doc_blobs": """SELECT DISTINCT sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size
    FROM documents""",
    "changes": """SELECT coalesce(p.root_id, c.root_id) AS root_id,
      coalesce(p.rel_path, c.rel_path) AS rel_path, p.rel_path IS NOT NULL AS was,
      CASE WHEN NOT coalesce(r.present, false) THEN 'offline'
        WHEN c.rel_path IS NULL AND p.state = 'present' THEN 'gone'
        WHEN c.rel_path IS NULL THEN 'missing' WHEN NOT c.readable THEN 'seen'
        WHEN p.rel_path IS NULL THEN 'new'
        WHEN p.size = c.size AND p.mtime = c.mtime AND p.ino = c.ino THEN 'unchanged'
        ELSE 'changed' END AS change,
      c.size AS csize, c.mtime AS cmtime, c.ino AS cino, c.sha256 AS csha, c.hash_state AS chash,
      c.parse_state AS cparse, c.parse_error AS cerror, c.is_symlink AS clink,
      p.size AS psize, p.mtime AS pmtime, p.ino AS pino, p.sha256 AS psha, p.hash_state AS phash,
      p.parse_state AS pparse, p.parse_error AS perror, p.is_symlink AS plink, p.state AS pstate
    FROM v_prev p FULL JOIN v_curr c ON p.root_id = c.root_id AND p.rel_path = c.rel_path
      LEFT JOIN v_scan_roots r ON r.root_id = coalesce(p.root_id, c.root_id)""",
    "next": """SELECT root_id, rel_path,
      CASE WHEN take THEN csize ELSE psize END AS size, CASE WHEN take THEN cmtime ELSE pmtime END AS mtime,
      CASE WHEN take THEN cino ELSE pino END AS ino, CASE WHEN take THEN clink ELSE plink END AS is_symlink,
      CASE WHEN take THEN csha WHEN change <> 'gone' THEN psha END AS sha256,
      CASE WHEN take THEN chash WHEN change = 'gone' THEN 'none' ELSE phash END AS hash_state,
      CASE WHEN take THEN cparse ELSE pparse END AS parse_state,
      CASE WHEN take THEN cerror ELSE perror END AS parse_error,
      CASE WHEN take THEN 'present' WHEN change = 'gone' THEN 'missing' ELSE pstate END AS state
    FROM (SELECT *, change IN ('new', 'changed', 'unchanged') AS take FROM changes)
    WHERE take OR was""",
    "report": """SELECT r.root_id, NOT r.present AS root_offline,
      count(*) FILTER (WHERE take OR change = 'seen') AS files_seen, count(*) FILTER (WHERE change = 'new') AS files_new,
      count(*) FILTER (WHERE change = 'changed') AS files_changed, count(*) FILTER (WHERE change = 'gone') AS files_gone,
      count(*) FILTER (WHERE take AND cparse = 'unsupported' AND NOT clink) AS files_unsupported,
      count(*) FILTER (WHERE take AND chash <> 'full') AS files_unverified,
      (SELECT count(*) FROM orders WHERE o_orderkey % 89 = 0 AND o_orderkey % 5 = r.root_id) AS families_new,
      CAST(0 AS BIGINT) AS duplicates,
      (SELECT count(*) FROM orders WHERE o_orderkey % 194 = 0 AND o_orderkey % 5 = r.root_id)
        AS skipped_symlink_dirs,
      CAST(0 AS BIGINT) AS skipped_non_utf8,
      (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 2 = 1
        AND o_orderkey % 5 = r.root_id) AS dirs_unreadable,
      CAST(0 AS BIGINT) AS skipped_deep
    FROM v_scan_roots r LEFT JOIN
      (SELECT *, change IN ('new', 'changed', 'unchanged') AS take FROM changes) c ON c.root_id = r.root_id
    GROUP BY r.root_id, r.present""",
    "pairs": """SELECT min(family_key) AS low, max(family_key) AS high FROM families
    WHERE arch IS NOT NULL GROUP BY name, arch HAVING min(family_key) <> max(family_key)""",
    "declined": f"""SELECT low AS family_a_key, high AS family_b_key, '1' AS algo_version,
      CAST({NOW} AS BIGINT) AS declined_at FROM pairs WHERE length(low) % 2 = 0""",
    "aliases": """SELECT low AS family_key, high AS alias, 'user' AS source FROM pairs
    WHERE length(low) % 2 <> 0""",
    "matches": """SELECT m.monitor_id, m.family_key, profile, x.*, cutoff_of(profile) AS cutoff
    FROM v_monitors m JOIN v_repos USING (family_key) JOIN
      (SELECT *, CASE WHEN contains(filename, 'Q4_K_M') THEN 'Q4_K_M'
                      WHEN contains(filename, 'Q5_K_M') THEN 'Q5_K_M'
                      WHEN contains(filename, 'Q8_0') THEN 'Q8_0' ELSE 'Q3_K_S' END AS quant,
         CASE WHEN contains(filename, 'bartowski') THEN 'bartowski'
              WHEN contains(filename, 'mradermacher') THEN 'mradermacher' ELSE 'unknown' END AS publisher
       FROM v_remote) x USING (repo)
    WHERE enabled AND (variant_family_key IS NULL OR variant_family_key = m.family_key)
      AND (variant_quant IS NULL OR variant_quant = quant)
      AND (profile = 'MACHINERY' OR filename LIKE '%.gguf')
      AND (profile <> 'BUILDING' OR (quant IN ('Q4_K_M', 'Q5_K_M') AND size <= 10000000))
      AND NOT contains(filename, CASE WHEN profile = 'AUTOMOBILE' THEN '-Q8' ELSE 'm77' END)""".replace(
        "cutoff_of(profile)", "CASE WHEN profile = 'HOUSEHOLD' THEN 'Q8_0' ELSE 'Q4_K_M' END"
    ),
    "chosen": """SELECT * EXCLUDE (pos, best) FROM
      (SELECT *, min(pos) OVER (PARTITION BY monitor_id) AS best FROM
        (SELECT *, CASE WHEN profile = 'FURNITURE' THEN 0 WHEN publisher = 'mradermacher' THEN 1
                        WHEN publisher = 'bartowski' THEN 2 END AS pos FROM matches) WHERE pos IS NOT NULL)
    WHERE pos = best""",
    "owned": """SELECT sha256,
      arg_min(f.root_id, (CASE WHEN r.present THEN 0 ELSE 1 END, f.root_id)) AS local_root_id,
      min(CASE WHEN r.present THEN 0 ELSE 1 END) = 1 AS only_offline
    FROM v_owned_files f LEFT JOIN v_roots r USING (root_id) WHERE hash_state = 'full' GROUP BY sha256""",
    "statuses": """SELECT monitor_id, c.family_key, c.quant,
      concat_ws('|', provider, repo, revision, filename) AS remote_key,
      provider, repo, revision, filename, size, c.sha256,
      CASE WHEN o.sha256 IS NOT NULL THEN 'skipped_have_bytes'
           WHEN EXISTS (SELECT 1 FROM v_local_variants v WHERE v.family_key = c.family_key
             AND v.rev_label = c.revision AND (v.quant = c.cutoff
               OR (c.cutoff = 'Q4_K_M' AND (v.quant = 'Q5_K_M'
                   OR (v.quant = 'Q8_0' AND c.profile <> 'BUILDING'))))) THEN 'satisfied'
           ELSE 'open' END AS status,
      local_root_id, coalesce(only_offline, false) AS only_offline
    FROM chosen c LEFT JOIN owned o ON o.sha256 = c.sha256""",
    "wanted": f"""SELECT remote_key, provider, repo, revision, filename, size, sha256, status,
      local_root_id, CAST({NOW} AS BIGINT) AS swept_at FROM statuses
    UNION ALL SELECT concat_ws('|', provider, repo, revision, filename) AS k, provider, repo, revision,
      filename, size, sha256, 'fetched', CAST(NULL AS BIGINT), CAST({NOW - 1000} AS BIGINT)
    FROM v_remote WHERE concat_ws('|', provider, repo, revision, filename) NOT IN (SELECT remote_key FROM statuses)""",
    "chain": """SELECT c_custkey AS k, c_custkey // 2 AS up FROM customer
    WHERE c_custkey > 0 AND c_custkey % 7 <> 0""",
    "a_roots": """SELECT k AS root_id, CASE WHEN k % 6 = 5 THEN concat('/mnt/n', k - 1, '/inner/deep')
        WHEN k % 9 = 8 THEN concat('/mnt/n', k - 1) ELSE concat('/mnt/n', k) END AS path,
      CASE WHEN k % 7 = 3 THEN 'floppy' WHEN k % 10 = 0 THEN 'fetch' ELSE 'nas' END AS kind,
      CASE WHEN k % 20 = 0 THEN 'fetch' ELSE 'catalogue' END AS mode,
      k % 20 = 0 OR k % 12 = 5 AS writable
    FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)""",
    "a_files": """SELECT p_partkey % 30 AS root_id,
      concat('p', p_partkey - CASE WHEN p_partkey % 100 = 31 THEN 30 ELSE 0 END) AS rel_path,
      sha256(p_name) AS sha256 FROM part""",
    "tree": """SELECT concat(replace(lower(p_brand), '#', '-'), '/', replace(p_name, ' ', '-'), '-', p_type,
      '-', p_partkey, '.gguf') AS rel_path, p_name, p_type, 1 AS n, CAST(p_size AS BIGINT) AS total FROM part""",
}


def _le32(n: str) -> str:
    h = f"printf('%08x', CAST({n} AS BIGINT))"
    return f"concat(substr({h}, 7, 2), substr({h}, 5, 2), substr({h}, 3, 2), substr({h}, 1, 2))"


def _le64(n: str) -> str:
    return f"concat({_le32(n)}, '00000000')"


def _text(s: str) -> str:
    return f"concat({_le64(f'strlen({s})')}, hex({s}))"


CTES["tree_bytes"] = f"""SELECT *, concat('47475546', {_le32('3')}, {_le64('1')}, {_le64('4')},
  {_text("'general.architecture'")}, {_le32('8')}, {_text('p_type')},
  {_text("'general.basename'")}, {_le32('8')}, {_text('p_name')},
  {_text("'general.file_type'")}, {_le32('4')}, {_le32('15')},
  {_text("concat(p_type, '.context_length')")}, {_le32('4')}, {_le32('4096')},
  {_text("'w'")}, {_le32('2')}, {_le64('n')}, {_le64('total')}, {_le32('0')}, {_le64('0')}) AS hx
FROM tree"""


_CHIPS = """SELECT r.family_key, bool_or(NOT s.present) AS offline,
      bool_or(coalesce(c.n > 1, false)) AS dups, bool_and(f.sha256 IS NOT NULL) AS have_bytes,
      array_to_string(list_sort(list(DISTINCT s.kind)), ',') AS sources
      FROM roles r JOIN v_files f ON f.rel_path = r.rel_path JOIN v_roots s ON s.root_id = f.root_id
      LEFT JOIN (SELECT sha256, count(*) AS n FROM v_files WHERE hash_state = 'full' AND state = 'present'
        GROUP BY ALL) c ON c.sha256 = f.sha256
      WHERE r.family_key IS NOT NULL GROUP BY r.family_key"""


CTES["all_of"] = f"""SELECT f.family_key, coalesce(offline, false) AS offline, coalesce(dups, false) AS dups,
      coalesce(have_bytes, false) AS have_bytes, coalesce(sources, '') AS sources
      FROM families f LEFT JOIN ({_CHIPS}) c ON c.family_key = f.family_key"""


def _sql(statement: str) -> str:
    """`statement` with the sub-queries it names, each after the ones it needs."""
    order: list[str] = []

    def add(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if word in CTES and word not in order and re.search(rf"\b(FROM|JOIN)\s+{word}\b", text):
                add(CTES[word])
                order.append(word)

    add(statement)
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in order)
    return f"WITH {parts}\n{statement}" if parts else statement


def _differing(a: str, b: str) -> str:
    names = ("size", "mtime", "ctime", "dev", "ino", "is_symlink", "symlink_target", "sha256", "hash_state",
             "parse_state", "parse_error", "state")
    return ", ".join(f"CASE WHEN {a}.{n} IS DISTINCT FROM {b}.{n} THEN '{n}' END" for n in names)


_AUDIT = """
      SELECT 'root.duplicate' AS rule, path AS subject, CAST(count(*) AS VARCHAR) AS detail FROM a_roots
        GROUP BY path HAVING count(*) > 1
      UNION ALL SELECT 'root.bad_kind', kind, CAST(count(*) AS VARCHAR) FROM a_roots WHERE kind = 'floppy'
        GROUP BY kind
      UNION ALL SELECT 'root.fetch_exists', kind, CAST(count(*) AS VARCHAR) FROM a_roots WHERE kind = 'fetch'
        GROUP BY kind HAVING count(*) > 1
      UNION ALL SELECT 'root.mode_mismatch', CAST(root_id AS VARCHAR), concat(kind, '/', mode) FROM a_roots
        WHERE NOT ((kind = 'fetch' AND mode = 'fetch' AND writable)
          OR (kind <> 'fetch' AND mode = 'catalogue' AND NOT writable))
      UNION ALL SELECT DISTINCT 'root.overlap', i.path, o.path FROM a_roots i JOIN a_roots o
        ON starts_with(i.path, concat(o.path, '/'))
      UNION ALL SELECT 'files.not_unique', concat(root_id, '|', rel_path), CAST(count(*) AS VARCHAR)
        FROM a_files GROUP BY root_id, rel_path HAVING count(*) > 1
      UNION ALL SELECT 'files.root_id_orphan', CAST(root_id AS VARCHAR), CAST(count(*) AS VARCHAR)
        FROM a_files WHERE root_id NOT IN (SELECT root_id FROM a_roots) GROUP BY root_id
      UNION ALL SELECT 'files.sha256_orphan', sha256, CAST(count(*) AS VARCHAR) FROM a_files
        WHERE sha256 NOT IN (SELECT sha256(p_name) FROM part WHERE p_size > 1 AND sha256(p_name) > '1')
        GROUP BY sha256
      UNION ALL SELECT 'families.not_unique', p_name, CAST(count(DISTINCT p_size = 50) AS VARCHAR) FROM part
        GROUP BY p_name HAVING count(DISTINCT p_size = 50) > 1
      UNION ALL SELECT 'families.bad_kind', 'lim', CAST(count(DISTINCT p_name) AS VARCHAR) FROM part
        WHERE p_size = 50 HAVING count(*) > 0
      UNION ALL SELECT 'evidence.bad_level', 'guess', CAST(count(*) AS VARCHAR) FROM events
        WHERE event_id % 500 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'declined_merges.unsorted', concat(c_name, '|', other), '1' FROM
        (SELECT c_name, concat('Customer#', lpad(CAST(2000 - c_custkey AS VARCHAR), 9, '0')) AS other FROM customer)
        WHERE c_name >= other
      UNION ALL SELECT 'monitors.family_key_orphan', concat('f', c_custkey), '1' FROM customer
      UNION ALL SELECT 'radar.variant_family_mismatch', CAST(c_custkey AS VARCHAR), 'another' FROM customer
        WHERE c_custkey % 50 = 7
      UNION ALL SELECT 'wanted.no_sha256', remote_key, 'd' FROM v_tasks
        WHERE CAST(regexp_extract(remote_key, '\\|m([0-9]+)-', 1) AS BIGINT) % 17 = 0
      UNION ALL SELECT 'file_roles.root_id_rel_path_orphan', concat(p_partkey % 30, '|p', p_partkey), '1' FROM part
        WHERE (p_partkey % 30, concat('p', p_partkey)) NOT IN (SELECT (root_id, rel_path) FROM a_files)
      UNION ALL SELECT 'file_roles.family_key_orphan', 'none', CAST(count(*) AS VARCHAR) FROM part
        WHERE p_partkey % 40 = 3 HAVING count(*) > 0"""

_SUGGESTIONS = f"""SELECT a.family_key AS a_key, b.family_key AS b_key,
      CASE WHEN abs(a.params_total - b.params_total)
        <= 0.15 * greatest(a.params_total, b.params_total) THEN 'params' ELSE 'name' END AS reason,
      len(list_filter(a.t, lambda x: list_contains(b.t, x))) AS shared_tokens,
      CAST(len(list_filter(a.t, lambda x: list_contains(b.t, x))) AS DOUBLE)
        / (len(a.t) + len(list_filter(b.t, lambda x: NOT list_contains(a.t, x)))) AS score
      FROM (SELECT *, {_tokens('family_key')} AS t FROM families) a
      JOIN (SELECT *, {_tokens('family_key')} AS t FROM families) b
        ON (a.first_root_id, a.first_rel_path, a.family_key) < (b.first_root_id, b.first_rel_path, b.family_key)
        AND a.arch IS NOT DISTINCT FROM b.arch AND list_has_any(a.t, b.t)
      WHERE (least(a.family_key, b.family_key), greatest(a.family_key, b.family_key)) NOT IN
        (SELECT (low, high) FROM pairs)"""

_STATEMENTS = {
    "dup_plan": """SELECT *, allocations - 1 AS reclaimable_files,
      (allocations - 1) * size AS reclaimable_bytes FROM groups""",
    "dup_copies": """SELECT d.sha256, d.root_id, r.name AS root_name, d.rel_path, dev, ino, copies, d.size
      FROM v_docs d JOIN groups g ON g.sha256 = d.sha256 JOIN v_roots r ON r.root_id = d.root_id
      WHERE hash_state = 'full' AND state = 'present'""",
    "dup_totals": """SELECT count(*) AS groups, CAST(sum(allocations - 1) AS BIGINT) AS reclaimable_files,
      CAST(sum((allocations - 1) * size) AS BIGINT) AS reclaimable_bytes FROM groups""",
    "have_bytes": """SELECT CAST(a.doc_id % 6 AS BIGINT) AS root_id, concat('d', a.doc_id) AS rel_path,
      coalesce(d.hash_state = 'full' AND d.sha256 IS NOT NULL, false) AS have_bytes
      FROM documents a LEFT JOIN v_docs d ON d.root_id = a.doc_id % 6 AND d.rel_path = concat('d', a.doc_id)""",
    "blob_refcount": """SELECT b.sha256, b.size, count(d.rel_path) AS refcount
      FROM doc_blobs b LEFT JOIN v_docs d ON d.sha256 = b.sha256 GROUP BY ALL""",
    "hash_gate": """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size,
      count(*) OVER (PARTITION BY strlen(text), CASE WHEN strlen(text) > 131072
        THEN sha256(unhex(concat(substr(hex(text), 1, 131072), substr(hex(text), length(hex(text)) - 131071, 131072))))
        ELSE sha256(text) END) > 1 AS collides FROM documents""",
    "staged_digests": """WITH f AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS whole,
        CASE WHEN strlen(text) > 128 THEN sha256(unhex(concat(substr(hex(text), 1, 128),
          substr(hex(text), length(hex(text)) - 127, 128)))) ELSE sha256(text) END AS edge FROM documents),
      k AS (SELECT size + doc_id % 2 AS size, CASE WHEN doc_id % 15 <> 0 THEN edge END AS edge FROM f WHERE doc_id % 3 = 0),
      s AS (SELECT *, count(*) OVER (PARTITION BY size) > 1 OR size IN (SELECT size FROM k) AS o1 FROM f),
      e AS (SELECT *, o1 AND (count(*) OVER (PARTITION BY size, edge) > 1 OR (size, edge) IN (SELECT (size, edge) FROM k WHERE edge IS NOT NULL)
        OR size IN (SELECT size FROM k WHERE edge IS NULL)) AS o2 FROM s)
      SELECT doc_id, size, CASE WHEN o2 THEN 'full' WHEN o1 THEN 'edges' ELSE 'size' END AS stage,
        CASE WHEN o1 THEN edge END AS partial_digest, CASE WHEN o2 THEN whole END AS sha256 FROM e""",
    "digest_tree": """WITH leaves AS (SELECT doc_id, p, sha256(unhex(concat('00', substr(hex(text), 1 + 512 * p, 512)))) AS d
        FROM (SELECT doc_id, text, unnest(range(greatest(1, (strlen(text) + 255) // 256))) AS p FROM documents)),
      one AS (SELECT doc_id, p // 8 AS p, CASE WHEN count(*) = 1 AND min(p) = 0 THEN min(d)
        ELSE sha256(unhex(concat('01', string_agg(d, '' ORDER BY p)))) END AS d FROM leaves GROUP BY doc_id, p // 8),
      two AS (SELECT doc_id, p // 8 AS p, CASE WHEN count(*) = 1 AND min(p) = 0 THEN min(d)
        ELSE sha256(unhex(concat('01', string_agg(d, '' ORDER BY p)))) END AS d FROM one GROUP BY doc_id, p // 8),
      three AS (SELECT doc_id, p // 8 AS p, CASE WHEN count(*) = 1 AND min(p) = 0 THEN min(d)
        ELSE sha256(unhex(concat('01', string_agg(d, '' ORDER BY p)))) END AS d FROM two GROUP BY doc_id, p // 8),
      four AS (SELECT doc_id, p // 8 AS p, CASE WHEN count(*) = 1 AND min(p) = 0 THEN min(d)
        ELSE sha256(unhex(concat('01', string_agg(d, '' ORDER BY p)))) END AS d FROM three GROUP BY doc_id, p // 8)
      SELECT doc_id, n AS pieces, d AS root_digest FROM four JOIN
        (SELECT doc_id, count(*) AS n FROM leaves GROUP BY doc_id) USING (doc_id)""",
    "broken_ranges": """WITH t AS (SELECT doc_id, hex(text) AS hx, strlen(text) AS n FROM documents),
      now AS (SELECT doc_id, hx AS was, n, CASE
          WHEN doc_id % 7 = 0 THEN concat(substr(hx, 1, 2 * (n // 2)), '7E', substr(hx, 2 * (n // 2) + 3))
          WHEN doc_id % 11 = 0 THEN substr(hx, 1, 2 * greatest(0, n - 100)) ELSE hx END AS hx FROM t),
      p AS (SELECT doc_id, p, substr(was, 1 + 512 * p, 512) AS a, substr(hx, 1 + 512 * p, 512) AS b,
          p < greatest(1, (length(was) // 2 + 255) // 256) AS ina, p < greatest(1, (length(hx) // 2 + 255) // 256) AS inb
        FROM (SELECT *, unnest(range(greatest(1, (greatest(length(was), length(hx)) // 2 + 255) // 256))) AS p FROM now)),
      b AS (SELECT doc_id, p, CASE WHEN NOT inb THEN 'missing' WHEN NOT ina THEN 'added' ELSE 'different' END AS verdict,
          256 * p + CASE WHEN inb THEN length(b) // 2 ELSE length(a) // 2 END AS e FROM p WHERE NOT ina OR NOT inb OR a <> b)
      SELECT doc_id, verdict, CAST(256 * min(p) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", count(*) AS pieces
      FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, verdict ORDER BY p) AS run FROM b)
      GROUP BY doc_id, verdict, run""",
    "content_digest": """SELECT doc_id, sha256(text) AS sha256,
      CASE WHEN strlen(text) > 512 THEN sha256(unhex(concat(substr(hex(text), 1, 512),
        substr(hex(text), length(hex(text)) - 511, 512)))) ELSE sha256(text) END AS partial_digest
      FROM documents""",
    "trusted_names": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN sha256(text) END AS sha256,
      doc_id % 5 IN (1, 2) AS is_partial FROM documents""",
    "name_facts": """SELECT rel_path, stem AS name_stem, role AS name_role, name_quant, name_publisher,
      name_subflavour, name_kind,
      TRY_CAST(regexp_extract(stem, '(?i)([0-9]+(\\.[0-9]+)?)\\s*b\\b', 1) AS DOUBLE) AS name_params
      FROM named""",
    "display_stem": "SELECT rel_path, display AS display_stem FROM named",
    "shard_strip": f"""SELECT rel_path, regexp_matches(stem, '{_SHARD}') AS is_shard,
      CASE WHEN regexp_matches(stem, '{_SHARD}') THEN regexp_replace(stem, '{_SHARD}', '') END AS stripped
      FROM named""",
    "url_slug": f"SELECT page_id, {_stem('url')} AS stem, {_slug('url')} AS slug FROM pages",
    "name_tokens": f"""SELECT rel_path, array_to_string({_tokens(_slug('stem'))}, ' ') AS tokens
      FROM named""",
    "name_similarity": f"""SELECT p_partkey, len(list_filter(b, lambda t: list_contains(a, t))) AS shared_tokens,
      CAST(len(list_filter(b, lambda t: list_contains(a, t))) AS DOUBLE)
        / (len(b) + len(list_filter(a, lambda t: NOT list_contains(b, t)))) AS score
      FROM (SELECT p_partkey, {_tokens(_slug('p_name'))} AS a,
        {_tokens(_slug("concat_ws(' ', p_type, p_name, p_brand, p_type)"))} AS b FROM part)""",
    "family_key": f"""SELECT p_partkey, {_round1('p_retailprice / 16')} AS rounded,
      {_key('p_name', 'p_type', 'p_retailprice / 16', 'CASE WHEN p_size % 2 = 0 THEN p_retailprice / 16 END')}
        AS family_key FROM part""",
    "file_type_quants": f"""SELECT p_partkey, {_quant_of_number('p_size % 40')} AS quant,
      CASE WHEN {_quant_of_number('p_size % 40')} IS NOT NULL THEN CAST(p_size % 40 AS BIGINT) END AS file_type
      FROM part""",
    "identify": f"""SELECT rel_path, role, is_unknown, family_key, name, name_level, quant, quant_level,
      quant_raw, quant_raw_level, kind, kind_level, subflavour, 'inferred' AS subflavour_level, publisher,
      'inferred' AS publisher_level, {_source('name_level')} AS name_source FROM ident""",
    "unknown_flag": "SELECT role, is_unknown, count(*) AS files FROM ident GROUP BY ALL",
    "families": "SELECT * FROM families",
    "revisions": "SELECT DISTINCT family_key, 'local' AS rev_kind, rev_label FROM models",
    "variants": "SELECT * FROM variants",
    "file_roles": "SELECT * FROM roles",
    "evidence_rows": """SELECT subject_type, subject_key, field, value, level, source,
      struct_extract(last_at, 1) AS root_id, struct_extract(last_at, 2) AS rel_path FROM facts""",
    "evidence_append": f"""SELECT subject_type, subject_key, field, value, level, source,
        CAST({NOW} AS BIGINT) AS recorded_at FROM
      (SELECT *, bool_or(fresh OR differs) OVER (PARTITION BY subject_type, subject_key, field) AS moves FROM
        (SELECT *, NOT logged_before AS fresh, back = 1 AND (newest IS NULL
            OR newest <> concat_ws('~', value, level, source)) AS differs FROM
          (SELECT f.*, row_number() OVER (PARTITION BY subject_type, subject_key, field
              ORDER BY last_at DESC, value DESC) AS back,
            CAST(regexp_extract(struct_extract(last_at, 2), '^p([0-9]+)/', 1) AS BIGINT) % 3 <> 0 AS logged_before,
            l.newest FROM facts f LEFT JOIN
            (SELECT subject_type AS st, subject_key AS sk, field AS sf,
               arg_max(concat_ws('~', value, level, source), seq) AS newest
             FROM logged WHERE seq % 3 <> 0 GROUP BY ALL) l
            ON l.st = subject_type AND l.sk = subject_key AND l.sf = field)))
      WHERE fresh OR (back = 1 AND moves)""",
    "home_counts": """SELECT (SELECT count(*) FROM families) AS families,
      (SELECT count(*) FROM families WHERE family_key NOT IN (SELECT subject_key FROM logged
        WHERE subject_type = 'family' AND field = 'name' AND level IN ('known', 'manual')))
        AS families_inferred,
      (SELECT CAST(sum(size) AS BIGINT) FROM v_files) AS bytes,
      (SELECT count(*) FROM v_files WHERE hash_state <> 'full') AS unverified_files,
      (SELECT count(*) FROM v_files WHERE parse_state = 'ok'
        AND rel_path NOT IN (SELECT rel_path FROM roles)) AS unknown_files""",
    "root_counts": """SELECT count(*) AS roots, count(*) FILTER (WHERE present) AS present_roots FROM v_roots
      WHERE root_id IN (SELECT root_id FROM v_docs)""",
    "family_list": """SELECT f.family_key, f.name, n.level AS name_level, f.kind, f.params_total,
      f.params_active, coalesce(q.quants, '') AS quants, coalesce(b.bytes, 0) AS bytes,
      coalesce(b.roots, '') AS roots
      FROM families f
      LEFT JOIN (SELECT subject_key, arg_max(level, seq) AS level FROM logged
        WHERE subject_type = 'family' AND field = 'name' GROUP BY ALL) n ON n.subject_key = f.family_key
      LEFT JOIN (SELECT family_key, array_to_string(list_sort(list(DISTINCT quant)), ',') AS quants
        FROM variants GROUP BY ALL) q ON q.family_key = f.family_key
      LEFT JOIN (SELECT r.family_key, CAST(sum(size) AS BIGINT) AS bytes,
          array_to_string(list_sort(list(DISTINCT concat(s.name, ':', s.present))), ',') AS roots
        FROM roles r JOIN v_files v ON v.root_id = r.root_id AND v.rel_path = r.rel_path
          JOIN v_roots s ON s.root_id = v.root_id GROUP BY r.family_key) b ON b.family_key = f.family_key""",
    "family_lookup": """SELECT request, arg_min(f.family_key, (first_root_id, first_rel_path, f.family_key))
        AS family_key
      FROM (SELECT p_name AS request FROM part UNION SELECT concat(p_name, ' Chat') FROM part
            UNION SELECT p_type FROM part UNION SELECT family_key FROM families) q
      LEFT JOIN families f ON f.family_key = request OR f.name = request GROUP BY request""",
    "variant_view": """SELECT v.family_key, v.rev_label, v.format, v.quant, v.subflavour, v.publisher,
      coalesce(CAST(sum(f.size) AS BIGINT), 0) AS bytes,
      coalesce(arg_min(s.name, (f.root_id, f.rel_path)), '') AS root,
      coalesce(arg_min(s.present, (f.root_id, f.rel_path)), false) AS present,
      max(f.mtime) AS last_file_mtime
      FROM variants v LEFT JOIN roles r ON r.family_key = v.family_key AND r.rev_label = v.rev_label
        AND r.format = v.format AND r.quant = v.quant AND r.subflavour = v.subflavour
        AND r.publisher = v.publisher
      LEFT JOIN v_files f ON f.root_id = r.root_id AND f.rel_path = r.rel_path
      LEFT JOIN v_roots s ON s.root_id = f.root_id
      GROUP BY v.family_key, v.rev_label, v.format, v.quant, v.subflavour, v.publisher""",
    "unknown_inbox": """SELECT root_id, rel_path, size, parse_state, hash_state FROM v_files
      WHERE sha256 IS NOT NULL AND rel_path NOT IN (SELECT rel_path FROM roles)""",
    "storage_by_root": """SELECT r.root_id, r.name, r.present,
      (SELECT count(*) FROM v_docs d WHERE d.root_id = r.root_id AND state = 'present') AS files,
      (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM v_docs d WHERE d.root_id = r.root_id
        AND state = 'present') AS bytes,
      CASE WHEN r.present THEN (SELECT CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) FROM
        (SELECT sha256, count(DISTINCT (dev, ino)) AS n, max(size) AS size FROM v_docs d
         WHERE d.root_id = r.root_id AND state = 'present' AND hash_state = 'full' GROUP BY sha256))
        ELSE 0 END AS reclaimable FROM v_roots r""",
    "storage_rollup": """
      SELECT CAST(0 AS BIGINT) AS level, root_id, family_key, CAST(sum(n) AS BIGINT) AS files,
        CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(u) AS BIGINT) AS unique_bytes FROM
        (SELECT f.root_id, family_key, sha256, count(*) AS n, sum(size) AS b,
           CASE WHEN sha256 IS NULL THEN sum(size) ELSE max(size) END AS u
         FROM v_files f LEFT JOIN roles r ON r.rel_path = f.rel_path
         WHERE state = 'present' GROUP BY f.root_id, family_key, sha256) GROUP BY root_id, family_key
      UNION ALL
      SELECT 1, root_id, NULL, CAST(sum(n) AS BIGINT), CAST(sum(b) AS BIGINT), CAST(sum(u) AS BIGINT) FROM
        (SELECT root_id, sha256, count(*) AS n, sum(size) AS b,
           CASE WHEN sha256 IS NULL THEN sum(size) ELSE max(size) END AS u
         FROM v_files WHERE state = 'present' GROUP BY root_id, sha256) GROUP BY root_id
      UNION ALL
      SELECT 2, NULL, NULL, CAST(sum(n) AS BIGINT), CAST(sum(b) AS BIGINT), CAST(sum(u) AS BIGINT) FROM
        (SELECT sha256, count(*) AS n, sum(size) AS b,
           CASE WHEN sha256 IS NULL THEN sum(size) ELSE max(size) END AS u
         FROM v_files WHERE state = 'present' GROUP BY sha256)""",
    "catalogue_search": f"""SELECT family_key, name, params_total FROM families f
      WHERE list_contains(string_split({_slug("concat_ws(' ', f.name, f.arch)")}, '-'), 'red')
        AND kind IS NOT NULL AND arch IS NOT NULL AND params_total BETWEEN 5 AND 40
        AND EXISTS (SELECT 1 FROM variants v WHERE v.family_key = f.family_key AND v.quant = 'Q4_K_M')""",
    "family_chips": _CHIPS,
    "filtered_search": """SELECT 'a' AS filter, family_key FROM all_of WHERE NOT offline AND list_contains(string_split(sources, ','), 'nas')
      UNION ALL SELECT 'b', family_key FROM all_of WHERE dups AND have_bytes
      UNION ALL SELECT 'c', family_key FROM all_of WHERE offline AND NOT dups""",
    "shard_sets": """SELECT CAST(o_orderkey % 5 AS BIGINT) AS root_id, concat('c', o_custkey) AS dir,
      concat('model-', o_orderstatus) AS base, CAST(3 AS BIGINT) AS parts_announced,
      count(DISTINCT o_orderkey % 3) AS parts_found, count(*) AS files,
      CAST(sum(o_custkey * 10 + o_orderkey % 10) AS BIGINT) AS bytes,
      count(DISTINCT o_orderkey % 3) = 3 AS complete
      FROM orders GROUP BY o_orderkey % 5, o_custkey, o_orderstatus""",
    "quant_ladder": """SELECT family_key,
      CASE WHEN bool_or(quant = 'Q3_K_S') THEN 'have' END AS "Q3_K_S",
      CASE WHEN bool_or(quant = 'Q4_K_M') THEN 'have' END AS "Q4_K_M",
      CASE WHEN bool_or(quant = 'Q5_K_M') THEN 'have' ELSE 'wanted' END AS "Q5_K_M",
      CASE WHEN bool_or(quant = 'Q8_0') THEN 'have' END AS "Q8_0"
      FROM v_local_variants GROUP BY family_key""",
    "listing_diff": "SELECT root_id, rel_path, change FROM changes",
    "next_files": "SELECT * FROM next",
    "missing_files": "SELECT root_id, rel_path FROM changes WHERE change = 'gone'",
    "offline_guard": """SELECT root_id, rel_path, size, sha256, hash_state, state FROM v_prev
      WHERE root_id = 2""",
    "scan_report": "SELECT * FROM report",
    "scan_history": f"""SELECT root_id, CAST({NOW} AS BIGINT) AS started, CAST({NOW + 60} AS BIGINT) AS finished,
      files_new, files_changed, files_gone, NOT root_offline AS ok FROM report""",
    "hash_decision": """SELECT root_id, rel_path, readable AND NOT is_symlink AS needs_hash FROM v_curr_whole""",
    "blob_upsert": """SELECT sha256, arg_max(size, seq) AS size,
      arg_max(partial_digest, seq) FILTER (partial_digest IS NOT NULL) AS partial_digest FROM
      (SELECT sha256, size, concat('p', rel_path) AS partial_digest, -1 AS seq FROM v_prev_whole
       UNION ALL
       SELECT CASE WHEN ino % 4 = 0 THEN sha256(CAST(ino AS VARCHAR)) ELSE sha256 END, size,
         CASE WHEN ino % 3 <> 0 THEN concat('n', ino) END, ino FROM v_curr_whole)
      WHERE sha256 IS NOT NULL GROUP BY sha256""",
    "root_removal": """SELECT 'roots' AS kept, root_id, count(*) AS rows FROM v_roots WHERE present GROUP BY ALL
      UNION ALL SELECT 'files', root_id, count(*) FROM v_files WHERE root_id % 2 = 1 GROUP BY ALL
      UNION ALL SELECT 'file_roles', root_id, count(*) FROM roles WHERE root_id % 2 = 1 GROUP BY ALL""",
    "inherited_presence": """SELECT rel_path, root_id, root_id % 2 = 1 AS root_present FROM v_files""",
    "latest_evidence": """SELECT subject_type, subject_key, field, seq, value, level, source, recorded_at
      FROM v_evidence QUALIFY row_number() OVER
        (PARTITION BY subject_type, subject_key, field ORDER BY seq DESC) = 1""",
    "truth_resolve": """SELECT subject_type, subject_key, field, value, level, source, seq
      FROM v_evidence QUALIFY row_number() OVER (PARTITION BY subject_type, subject_key, field
        ORDER BY CASE level WHEN 'manual' THEN 1 WHEN 'known' THEN 2 WHEN 'detected' THEN 3
          WHEN 'inferred' THEN 4 ELSE 5 END, seq DESC) = 1""",
    "provenance_timeline": "SELECT * FROM v_provenance",
    "presence_hysteresis": """SELECT p.root_id, count(*) AS probes,
      count(*) FILTER (WHERE failed AND (o.last IS NULL OR ("at", seq) > o.last)) AS failures_in_a_row,
      struct_extract(any_value(o.last), 1) AS last_ok_at,
      count(*) FILTER (WHERE failed AND (o.last IS NULL OR ("at", seq) > o.last)) < 2 AS present
      FROM v_probe p LEFT JOIN (SELECT root_id, max(("at", seq)) AS last FROM v_probe WHERE NOT failed
        GROUP BY root_id) o ON o.root_id = p.root_id GROUP BY p.root_id""",
    "presence_states": """SELECT root_id, "at", seq, failed, CAST(r AS BIGINT) AS failures_in_a_row, r < 2 AS present,
        (r < 2) <> (coalesce(lag(r) OVER (PARTITION BY root_id ORDER BY "at", seq), 0) < 2) AS changed
      FROM (SELECT *, row_number() OVER w - coalesce(max(ok) OVER w, 0) AS r
        FROM (SELECT *, CASE WHEN NOT failed THEN row_number() OVER (PARTITION BY root_id ORDER BY "at", seq) END AS ok FROM v_probe)
        WINDOW w AS (PARTITION BY root_id ORDER BY "at", seq ROWS UNBOUNDED PRECEDING))""",
    "index_enrichment": f"""SELECT 'blob' AS subject_type, sha256(text) AS subject_key, 'index' AS provider,
      source AS repo, concat('f', doc_id) AS filename,
      concat('{{"repo":"', source, '","filename":"f', doc_id, '"}}') AS payload_json, 'external' AS level,
      CAST({NOW} AS BIGINT) AS fetched_at FROM documents WHERE doc_id % 3 = 0""",
    "declined_pairs": f"""SELECT a AS family_a_key, b AS family_b_key, rule AS algo_version,
      coalesce(min(made) FILTER (WHERE old), CAST({NOW} AS BIGINT)) AS declined_at FROM
      (SELECT least(CAST(o_custkey AS VARCHAR), o_orderstatus) AS a,
         greatest(CAST(o_custkey AS VARCHAR), o_orderstatus) AS b, false AS old, o_orderkey AS made, '1' AS rule
         FROM orders
       UNION ALL
       SELECT least(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)),
         greatest(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)), true, o_orderkey,
         CASE WHEN o_orderkey % 50 = 0 THEN '1' ELSE '0' END FROM orders) GROUP BY a, b, rule""",
    "merge_suggestions": _SUGGESTIONS,
    "asked_suggestions": f"""SELECT * FROM ({_SUGGESTIONS}) WHERE length(a_key) % 4 = 0 OR length(b_key) % 4 = 0""",
    "close_suggestions": f"""SELECT * FROM ({_SUGGESTIONS}) WHERE score >= 0.6""",
    "followed_suggestions": _SUGGESTIONS,
    "merged_families": """SELECT coalesce(i.family_key, f.family_key) AS family_key, name, arch, params_total FROM families f
      LEFT JOIN (SELECT concat('into|', arch) AS family_key, family_key AS alias FROM families
          WHERE length(family_key) % 5 = 0 AND arch IS NOT NULL
        UNION ALL SELECT CASE WHEN length(a.family_key) % 5 = 0 THEN concat('into|', t.arch) ELSE a.family_key END, alias
          FROM aliases a JOIN families t ON t.family_key = a.family_key WHERE length(alias) % 5 <> 0) i ON i.alias = f.family_key
      QUALIFY row_number() OVER (PARTITION BY coalesce(i.family_key, f.family_key)
        ORDER BY i.alias IS NOT NULL, f.family_key) = 1""",
    "import_decisions": """WITH RECURSIVE own AS (SELECT concat('f', c_custkey) AS alias, concat('f', c_custkey // 2) AS family_key
        FROM customer WHERE c_custkey % 3 = 0 AND c_custkey <> c_custkey // 2),
      theirs AS (SELECT concat('f', k) AS alias, concat('f', up) AS family_key FROM
        (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 20 THEN c_custkey + 1 WHEN c_custkey % 50 = 21 THEN c_custkey - 1
           WHEN c_custkey % 15 = 0 THEN c_custkey + 3 WHEN c_custkey % 3 = 1 THEN c_custkey // 2 END AS up FROM customer) WHERE up IS NOT NULL),
      said AS (SELECT true AS mine, c_custkey AS k, c_custkey + 1 AS n, 10 AS made FROM customer WHERE c_custkey % 11 = 0
        UNION ALL SELECT true, c_custkey, c_custkey // 2, 20 FROM customer WHERE c_custkey % 17 = 0
        UNION ALL SELECT false, c_custkey, c_custkey // 2, 5 FROM customer WHERE c_custkey % 13 = 0
        UNION ALL SELECT false, c_custkey, c_custkey + 1, 3 FROM customer WHERE c_custkey % 11 = 0),
      no AS (SELECT mine, least(concat('f', k), concat('f', n)) AS a, greatest(concat('f', k), concat('f', n)) AS b, made FROM said),
      refused AS (SELECT DISTINCT a, b FROM no WHERE mine),
      offered AS (SELECT t.*, o.family_key AS own_key, r.a IS NOT NULL AS refused FROM theirs t LEFT JOIN own o USING (alias)
        LEFT JOIN refused r ON r.a = least(t.alias, t.family_key) AND r.b = greatest(t.alias, t.family_key)),
      fresh AS (SELECT alias, family_key FROM offered WHERE own_key IS NULL AND NOT refused),
      united AS (SELECT alias, family_key, 'user' AS source FROM own UNION ALL SELECT alias, family_key, 'import' FROM fresh),
      reach(s, n) AS (SELECT alias, family_key FROM united UNION SELECT s, u.family_key FROM reach JOIN united u ON u.alias = n),
      circles AS (SELECT s FROM reach WHERE s = n AND s IN (SELECT alias FROM fresh)),
      merged AS (SELECT * FROM united WHERE alias NOT IN (SELECT s FROM circles)),
      walk(s, n) AS (SELECT alias, family_key FROM merged UNION SELECT s, m.family_key FROM walk JOIN merged m ON m.alias = n),
      tops AS (SELECT s, n FROM walk WHERE n NOT IN (SELECT alias FROM merged)),
      dates AS (SELECT a, b, min(made) AS made FROM no GROUP BY a, b)
      SELECT 'alias' AS section, alias AS a, family_key AS b, source AS c FROM merged
      UNION ALL SELECT 'declined', a, b, CAST(made AS VARCHAR) FROM dates
      UNION ALL SELECT 'conflict', o.alias, o.family_key, 'alias.two_targets' FROM offered o LEFT JOIN tops x ON x.s = o.family_key
        LEFT JOIN tops y ON y.s = o.own_key WHERE own_key IS NOT NULL AND coalesce(x.n, o.family_key) <> coalesce(y.n, o.own_key)
      UNION ALL SELECT 'conflict', alias, family_key, 'alias.declined' FROM offered WHERE own_key IS NULL AND refused
      UNION ALL SELECT 'conflict', alias, family_key, 'alias.circle' FROM fresh WHERE alias IN (SELECT s FROM circles)
      UNION ALL SELECT 'conflict', a, b, 'merge.declined' FROM dates LEFT JOIN tops x ON x.s = a LEFT JOIN tops y ON y.s = b
        WHERE coalesce(x.n, a) = coalesce(y.n, b)""",
    "alias_applied": """SELECT was, family_key, count(*) AS variants FROM (
      SELECT v.family_key AS was, coalesce('f' || e.top, v.family_key) AS family_key
      FROM v_local_variants v LEFT JOIN
        (WITH RECURSIVE up(k, top) AS (SELECT k, up FROM chain
           UNION ALL SELECT up.k, chain.up FROM up JOIN chain ON chain.k = up.top)
         SELECT k, min(top) AS top FROM up GROUP BY k) e ON concat('f', e.k) = v.family_key)
      GROUP BY ALL""",
    "profile_match": "SELECT monitor_id, repo, revision, filename, quant, publisher FROM matches",
    "publisher_choice": "SELECT monitor_id, filename, publisher FROM chosen",
    "owned_blobs": "SELECT * FROM owned",
    "wanted_status": "SELECT monitor_id, remote_key, status, local_root_id, only_offline FROM statuses",
    "wanted_upsert": "SELECT * FROM wanted",
    "wanted_offline": """SELECT remote_key, r.name AS root FROM wanted w JOIN v_roots r
      ON r.root_id = w.local_root_id WHERE status = 'skipped_have_bytes' AND NOT r.present""",
    "fetch_eligibility": """SELECT remote_key, concat_ws(',',
        CASE WHEN w.sha256 IS NULL THEN 'wanted.no_sha256' END,
        CASE WHEN k % 8 < 4 THEN 'fetch.path_invalid' END,
        CASE WHEN w.sha256 IN (SELECT sha256 FROM owned) THEN 'fetch.already_owned' END,
        CASE WHEN k % 7 = 0 AND k % 5 IN (1, 2) THEN 'fetch.task_active' END) AS failed,
      NOT (w.sha256 IS NULL OR k % 8 < 4 OR w.sha256 IN (SELECT sha256 FROM owned)
        OR (k % 7 = 0 AND k % 5 IN (1, 2))) AS eligible
      FROM (SELECT *, CAST(regexp_extract(filename, '^m([0-9]+)', 1) AS BIGINT) AS k FROM wanted) w""",
    "integrity_audit": _AUDIT,
    "audit_followed": f"""SELECT rule, subject, detail FROM ({_AUDIT}) WHERE NOT starts_with(rule, 'file_roles.')""",
    "header_facts": f"""SELECT k AS file_id, format, CASE WHEN ok THEN p_name END AS basename,
      CASE WHEN ok THEN p_type END AS arch,
      CASE WHEN ok THEN CAST(p_size * (1000 + k % 7) AS DOUBLE) END AS params_total,
      CASE WHEN ok THEN CAST(p_size * 64 AS BIGINT) END AS context_len,
      CASE WHEN ok THEN CAST(p_size % 40 AS BIGINT) END AS file_type,
      CASE WHEN ok THEN {_quant_of_number('p_size % 40')} END AS quant_from_header,
      CASE WHEN ok THEN 'llm' WHEN format = 'onnx' THEN 'unknown' END AS kind,
      CASE WHEN ok THEN 'known' WHEN format = 'onnx' THEN 'detected' END AS kind_level,
      CASE WHEN format = 'unknown' THEN 'unsupported' WHEN format = 'onnx' OR ok THEN NULL
        WHEN k % 13 = 0 THEN 'gguf.unsupported_version' ELSE 'gguf.truncated' END AS parse_error
      FROM (SELECT *, format = 'gguf' AND k % 13 <> 0 AND k % 17 <> 0 AS ok FROM
        (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 38 = 0 THEN 'onnx'
           WHEN p_partkey % 19 = 0 THEN 'unknown' ELSE 'gguf' END AS format FROM part))""",
    "safetensors_facts": """SELECT k AS file_id, 'safetensors' AS format, CAST(NULL AS VARCHAR) AS basename,
      CASE WHEN ok AND k % 3 = 0 THEN 'QwenForCausalLM' WHEN ok AND k % 3 = 1
        THEN concat(p_type, 'VisionModel') END AS arch,
      CASE WHEN ok THEN CAST(p_size * 128 + 1 AS DOUBLE) END AS params_total,
      CAST(NULL AS BIGINT) AS context_len, CAST(NULL AS BIGINT) AS file_type,
      CAST(NULL AS VARCHAR) AS quant_from_header,
      CASE WHEN ok AND k % 3 = 0 THEN 'llm' WHEN ok AND k % 3 = 1 THEN 'vision' END AS kind,
      CASE WHEN ok AND k % 3 < 2 THEN 'inferred' END AS kind_level,
      CASE WHEN k % 11 <> 0 AND k % 13 = 0 THEN 'safetensors.bad_json' END AS parse_error
      FROM (SELECT *, p_partkey AS k, p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS ok FROM part)""",
    "listing_source": """SELECT rel_path, CAST(length(hx) // 2 AS BIGINT) AS size, false AS is_symlink,
      true AS readable FROM tree_bytes""",
    "batch_identify": f"""SELECT rel_path, CAST(length(hx) // 2 AS BIGINT) AS size, 'gguf' AS format,
      'weights' AS role, {_key('p_name', 'p_type', 'CAST(n * total AS DOUBLE)', 'CAST(NULL AS DOUBLE)')}
        AS family_key, false AS is_unknown, 'Q4_K_M' AS quant, 'known' AS quant_level,
      p_name AS name, 'known' AS name_level, CAST(n * total AS DOUBLE) AS params_total,
      CAST(4096 AS BIGINT) AS context_len, sha256(unhex(hx)) AS sha256 FROM tree_bytes""",
    "verify_digests": """SELECT rel_path, CASE WHEN length(rel_path) % 5 = 0 THEN sha256(rel_path)
        ELSE sha256(unhex(hx)) END AS stored_sha256, sha256(unhex(hx)) AS sha256,
      CASE WHEN length(rel_path) % 5 = 0 THEN 'different' ELSE 'same' END AS verdict FROM tree_bytes""",
    "snapshot_difference": f"""SELECT coalesce(p.root_id, c.root_id) AS root_id, coalesce(p.rel_path, c.rel_path) AS rel_path,
        CASE WHEN p.rel_path IS NULL THEN 'added' WHEN c.rel_path IS NULL THEN 'removed' ELSE 'changed' END AS change,
        CASE WHEN p.rel_path IS NOT NULL AND c.rel_path IS NOT NULL THEN concat_ws(',', {_differing('p', 'c')}) END AS columns
      FROM (SELECT * FROM v_prev WHERE root_id % 2 = 0) p FULL JOIN (SELECT * FROM v_curr WHERE root_id % 2 = 0) c
        ON p.root_id = c.root_id AND p.rel_path = c.rel_path
      WHERE p.rel_path IS NULL OR c.rel_path IS NULL OR concat_ws(',', {_differing('p', 'c')}) <> ''""",
    "export_manifest": """SELECT 'roots' AS section, CAST(root_id AS VARCHAR) AS key,
        CAST(to_json(r) AS VARCHAR) AS payload FROM v_roots r
      UNION ALL SELECT 'blobs', sha256, CAST(to_json(b) AS VARCHAR) FROM
        (SELECT sha256, max(size) AS size, CAST(NULL AS VARCHAR) AS partial_digest, count(*) AS refcount
         FROM v_files WHERE sha256 IS NOT NULL GROUP BY sha256) b
      UNION ALL SELECT 'family_aliases', alias, CAST(to_json(a) AS VARCHAR) FROM aliases a
      UNION ALL SELECT 'declined_merges', concat_ws('|', family_a_key, family_b_key, algo_version),
        CAST(to_json(d) AS VARCHAR) FROM declined d
      UNION ALL SELECT 'files', concat_ws('|', root_id, rel_path), CAST(to_json(f) AS VARCHAR) FROM
        (SELECT root_id, rel_path, size, sha256, hash_state, parse_state, state FROM v_files) f""",
    "import_manifest": """SELECT CASE WHEN root_id = 4 THEN NULL ELSE root_id + 10 END AS root_id, rel_path, size,
      sha256, hash_state, parse_state, state FROM v_files WHERE root_id <> 4""",
}

ORACLE = {name: _sql(text) for name, text in _STATEMENTS.items()}
