"""Which operator and which registered query answers each command of a key-value client.

A row is (commands, operator, query); an empty query means that no query of its own checks those commands. Families that differ in the number of dimensions only are made by a rule.
"""

from __future__ import annotations

import importlib

ROWS = [
    ("GET HGET", "operators.store.get", "kv_get"),
    ("MGET HMGET", "operators.store.mget", "kv_mget"),
    ("EXISTS HEXISTS", "operators.store.exists", "kv_exists"),
    ("TTL EXPIRETIME STRLEN SIZE SIZEOF SIZE_OF", "operators.store.meta", "kv_meta"),
    ("DUMP", "operators.store.dump", "kv_dump"),
    ("GETRANGE", "operators.store.getrange", "kv_getrange"),
    ("XNGET GETX", "operators.scan.page", "scan_prefix"),
    ("XRGET", "operators.scan.page", "scan_range"),
    ("XUGET", "operators.scan.page", "scan_unbounded"),
    ("XNGETKEYS", "operators.scan.page", "scan_prefix_keys"),
    ("XRGETKEYS", "operators.scan.page", "scan_range_keys"),
    ("XUGETKEYS", "operators.scan.page", "scan_unbounded_keys"),
    ("XNNEXT", "operators.scan.next_row", "next_prefix"),
    ("XRNEXT", "operators.scan.next_row", "next_range"),
    ("XUNEXT", "operators.scan.next_row", "next_unbounded"),
    ("HGETALL HGETVALS", "operators.store.fields", "kv_hash_fields"),
    ("HGETKEYS HLEN", "operators.containers.hash_read", "hash_read"),
    ("COUNT", "operators.scan.accumulate", "acc_count_limited"),
    ("SUM", "operators.scan.accumulate", "acc_sum_limited"),
    *[(f"XN{n}", "operators.scan.accumulate", f"acc_{n.lower()}_prefix") for n in ("COUNT", "SUM", "MIN", "MAX", "FIRST", "LAST", "AVG")],
    *[(f"XR{n}", "operators.scan.accumulate", f"acc_{n.lower()}_range") for n in ("COUNT", "SUM", "MIN", "MAX", "FIRST", "LAST", "AVG")],
    ("SET MSET HSET HMSET", "operators.store.put", "kv_set"),
    ("SETEX", "operators.store.put", "kv_setex"),
    ("SETNX", "operators.store.put_absent", "kv_setnx"),
    ("SETXX", "operators.store.put_present", "kv_setxx"),
    ("MSETNX", "operators.store.put_all_absent", "kv_msetnx"),
    ("MSETXX", "operators.store.put_all_present", "kv_msetxx"),
    ("DEL UNLINK HDEL", "operators.store.delete", "kv_delete"),
    ("APPEND", "operators.store.append", "kv_append"),
    ("EXPIRE XNEXPIRE XREXPIRE HEXPIREALL", "operators.store.expire", "kv_expire_prefix"),
    ("EXPIREAT XNEXPIREAT XREXPIREAT XREXPIREAY HEXPIREATALL", "operators.store.expire_at", "kv_expire_at_prefix"),
    ("PERSIST XNPERSIST XRPERSIST HPERSISTALL", "operators.store.persist", "kv_persist_prefix"),
    ("PERSISTDELETED PERSISTEXPIRED", "operators.store.revive", "kv_revive"),
    ("GETSET", "operators.store.swap", "kv_getset"),
    ("GETDEL", "operators.store.get_and", "kv_getdel"),
    ("GETEX GETEXAT", "operators.store.get_and", "kv_getex_writes"),
    ("GETPERSIST", "operators.store.get_and", "kv_getpersist_writes"),
    ("XNDEL HDELALL", "operators.store.delete", "kv_delete_prefix"),
    ("XRDEL", "operators.store.delete", "kv_delete_range"),
    ("CAS", "operators.store.compare_and_set", "kv_cas"),
    ("CAD", "operators.store.compare_and_delete", "kv_cad"),
    ("COPY", "operators.store.copy", "kv_copy"),
    ("COPYNX", "operators.store.copy", "kv_copynx"),
    ("RENAME MOVE", "operators.store.copy", "kv_rename"),
    ("RENAMENX MOVENX", "operators.store.copy", "kv_renamenx"),
    ("INCR INCRBY DECR DECRBY", "operators.counters.totals", "cnt_totals"),
    ("INCRLIMIT", "operators.counters.limited", "cnt_limited_up"),
    ("DECRLIMIT", "operators.counters.limited", "cnt_limited_down"),
    ("INCRTO DECRTO", "operators.counters.extremes", "cnt_extremes"),
    ("IGETALL IGETKEYS IGETVALS IGET IMGET", "operators.containers.record_all", "isam_all"),
    ("ISETALL", "operators.containers.record_pack", "isam_pack"),
    ("ISET", "operators.containers.record_set", "isam_set"),
    ("IDEL IRESERVE", "operators.containers.record_clear", "isam_clear"),
    ("SADD SPOP", "operators.containers.queue_pop", "queue_pop"),
    ("BITSET SETBIT BITMSET BITCOUNT BITMAX", "operators.containers.bit_count", "bit_count"),
    ("BITGET GETBIT BITMGET", "operators.containers.bit_get", "bit_get"),
    ("PFADD HLLADD PFADDCOUNT HLLADDCOUNT", "operators.sketches.hll", "hll_count"),
    ("PFSET HLLSET PFRESERVE HLLRESERVE PFBITS HLLBITS PFERROR HLLERROR", "operators.sketches.hll", ""),
    ("PFCOUNT HLLCOUNT PFMERGE HLLMERGE", "operators.sketches.hll_merge", "hll_union"),
    ("PFINTERSECT HLLINTERSECT PFJACCARD HLLJACCARD PFMJACCARD HLLMJACCARD PFOVERLAP HLLOVERLAP PFMOVERLAP HLLMOVERLAP", "operators.sketches.hll_relations", "hll_relations"),
    ("BFADD BFMADD BFEXISTS BFMEXISTS", "operators.sketches.bloom_exists", "bf_exists"),
    ("BFRESERVE", "operators.sketches.bloom", "bf_errors"),
    *[
        row
        for name in ("CBF", "CMS")
        for row in (
            (f"{name}ADD {name}INCR {name}INCRBY {name}ADDCOUNT {name}COUNT {name}MCOUNT", "operators.sketches.counters_estimate", f"{name.lower()}_estimate"),
            (f"{name}REM {name}DECR {name}DECRBY {name}REMCOUNT", "operators.sketches.counters", f"{name.lower()}_taken"),
            (f"{name}RESERVE", "operators.sketches.counters", f"{name.lower()}_crowded"),
        )
    ],
    ("CFADD CFMADD CFREM CFMREM CFEXISTS CFMEXISTS CFRESERVE", "operators.sketches.cuckoo", "cuckoo_ops"),
    ("HHINCR HHRESERVE HHGET", "operators.sketches.top_scores", "hh_top"),
    ("HHDECR", "operators.sketches.top_scores", "hh_bottom"),
    ("MGADD MGINCR MGADDGET MGRESERVE MGGET", "operators.sketches.misra_gries", "mg_exact"),
    ("RSADD RSRESERVE RSGET RSGETCOUNT", "operators.sketches.reservoir", "rs_sample"),
    ("RBRESERVE RBADD RBPUSH RBGET RBCOUNT RBLEN", "operators.containers.ring", "ring_last"),
    ("RBPOP", "operators.containers.ring", "ring_popped"),
    ("SLADD SLPUSH SLADDPACK SLPUSHPACK SLADDSHORT SLPUSHSHORT SLGET SLMGET SLGETALL SLCOUNT SLLEN", "operators.containers.list_get", "list_get"),
    ("SSRESERVE SSADD SSGETALL", "operators.summary.collect", "ss_by_group"),
    ("SSMERGE", "operators.summary.merge", "ss_merge"),
    ("SSGET SSMGET", "operators.summary.as_rows", "ss_named_rows"),
    ("SSADDGETALL SSADDGET SSADDMGET", "operators.summary.running", "ss_running"),
    ("TDRESERVE TDADD TDADDWEIGHT", "operators.sketches.digest", "td_percentiles"),
    ("TDMERGE TDMERGECAPACITY TDMERGECAP", "operators.sketches.digest", "td_compressed"),
    ("TDPERCENTILE TDQUANTILE THQUANTILE TDMPERCENTILE TDMQUANTILE THMQUANTILE TDMEDIAN", "operators.sketches.digest_percentiles", "td_percentiles"),
    ("TDTRIMMEDMEAN", "operators.sketches.digest_trimmed_mean", "td_trimmed_mean"),
    ("TDMEAN TDMIN TDMAX TDSIZE TDINFO", "operators.sketches.digest_info", "td_info"),
    ("GEOADD GEOREM GEOREMOVE GEODEL GEOGET GEOSCORE GEOMGET", "operators.indexes.geo_format", "geo_encode"),
    ("GEORADIUS GEORADIUS_RO", "operators.indexes.geo_radius", "geo_radius"),
    ("GEODIST", "operators.indexes.geo_distance", "geo_distance"),
    ("GEOENCODE GEODECODE", "functions.geohash.encode", "geo_encode"),
    *[(f"MC{n}GET MC{n}MGET MC{n}EXISTS MC{n}SCORE MC{n}ADD MC{n}REM MC{n}REMOVE MC{n}DEL", "operators.indexes.lookup", "ix_lookup") for n in (1, 2, 3, 4, 8, 16)],
    ("MC1POINT", "operators.indexes.linear_range", "mc1_point"),
    ("MC1RANGE", "operators.indexes.linear_range", "mc1_range"),
    *[(f"MC{n}POINT", "operators.indexes.point", f"mc{n}_point") for n in (2, 3, 4, 8, 16)],
    *[(f"MC{n}RANGE MC{n}RANGENAIVE MC{n}RANGEFLAT", "operators.indexes.box", f"mc{n}_range") for n in (2, 3, 4, 8, 16)],
    *[(f"MC{n}ENCODE MC{n}DECODE", "functions.zorder.encode", f"mc{n}_encode") for n in (2, 3, 4, 8, 16)],
    *[(f"IX{n}GET IX{n}MGET IX{n}EXISTS IX{n}GETINDEXES", "operators.indexes.lookup", "ix_lookup") for n in range(1, 7)],
    *[(f"IX{n}ADD IX{n}REM IX{n}REMOVE IX{n}DEL", "operators.indexes.current", "ix_current") for n in range(1, 7)],
    *[(f"IX{n}RANGE", "operators.indexes.composite_range", f"ix{n}_range") for n in range(1, 7)],
    *[(f"{p}GET {p}MGET {p}EXISTS {p}GETINDEXES", "operators.text.stored_postings", "fts_word") for p in ("IXM", "IXT", "IXH")],
    *[(f"{p}REM {p}REMOVE {p}DEL", "operators.text.remove", "fts_changed") for p in ("IXM", "IXT", "IXH")],
    ("IXMADD", "operators.text.postings", "fts_index"),
    ("IXMRANGE", "operators.text.search_word", "fts_word"),
    ("IXMRANGEFLEX", "operators.text.search_any", "fts_any"),
    ("IXMRANGESTRICT", "operators.text.search_all", "fts_all"),
    ("IXTADD IXTADD_UTF8", "operators.text.grams", "trigram_index"),
    ("IXTADD_BIN", "operators.text.byte_grams", "trigram_bytes"),
    ("IXTRANGEFLEX IXTRANGEFLEX_UTF8 IXTRANGEFLEX_BIN", "operators.text.search_any", "trigram_any"),
    ("IXTRANGESTRICT IXTRANGESTRICT_UTF8 IXTRANGESTRICT_BIN", "operators.text.search_all", "trigram_all"),
    ("IXHADD IXHADD_UTF8 IXHADD_BIN", "operators.text.hybrid", "hybrid_index"),
    ("ACADD ACADD_UTF8 ACADD_BIN ACDEL ACDEL_UTF8 ACDEL_BIN ACREM ACREM_UTF8 ACREM_BIN ACREMOVE ACREMOVE_UTF8 ACREMOVE_BIN", "operators.text.prefixes", "ac_index"),
    ("ACRANGE ACRANGE_UTF8 ACRANGE_BIN", "operators.text.complete_stored", "ac_range"),
    ("ACRANGEALL ACRANGEALL_UTF8 ACRANGEALL_BIN", "operators.text.complete_stored", "ac_all"),
    ("VADD VKSET", "operators.vectors.prepare", "vec_prepare"),
    ("VREM VREMOVE VDEL", "operators.store.delete", "kv_delete"),
    ("VGET VKGET", "operators.vectors.quantize", "vec_quantized"),
    ("VGETRAW VGETBLOB VKGETRAW VKGETBLOB", "operators.vectors.raw_hex", "vec_raw"),
    ("VGETNORMALIZED VGETNORM VKGETNORMALIZED VKGETNORM", "operators.vectors.normalized", "vec_normalized"),
    ("VSIMFLAT VKSIMFLAT", "operators.vectors.nearest", "vec_cosine"),
    ("VSIMLSH", "operators.vectors.nearest_lsh", "vec_lsh_one"),
    ("MURMUR MURMURHASH64A", "functions.hashing.murmur", "hash_murmur"),
    ("RANDOM RAND MRANDOM MRAND", "functions.hashing.mixed", "hash_mixed"),
    ("DBSIZE DBSIZEMUTABLE INFO", "operators.store.size", "kv_size"),
    ("SAVE BGSAVE", "operators.store.write_sorted", "disk_table"),
    ("RELOAD", "sources.files.reload", "disk_reload"),
    ("MAXKEYSIZE MAXVALSIZE VERSION UNIQUEID UNIQID TIME ECHO TYPE", "functions.session.constants", "session_constants"),
]

#: Talk between a client and a server process, which a library has no use for.
WITHOUT_MEANING = "PING REM COMMAND SELECT RESET TOUCH LISTMAINTAINANCE EXIT QUIT SHUTDOWN".split()


def operator(path: str):
    """The function a row names."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(f"lodeline.{module}"), name)


def catalogue() -> dict[str, tuple[str, str]]:
    """Command -> (operator, query)."""
    return {c: (path, query) for commands, path, query in ROWS for c in commands.split()}
