"""Declared schemas: inputs are checked against these, never inferred."""

from __future__ import annotations

INPUT_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"

DOMAIN_TABLES = {
    "organizations": "id string, name string, slug string, active boolean, created_at timestamp_ntz",
    "users": "id string, name string, email string, platform_role string, active boolean, "
             "must_change_password boolean, created_at timestamp_ntz, last_login_at timestamp_ntz",
    "memberships": "id string, user_id string, organization_id string, role string, created_at timestamp_ntz",
    "projects": "id string, organization_id string, name string, slug string, status string, access_mode string, "
                "client_can_edit boolean, description string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "project_versions": "id string, project_id string, source_pdf_path string, map_html_path string, "
                        "lot_count int, quality string, status string, validation_summary string, "
                        "is_published boolean, created_at timestamp_ntz",
    "file_assets": "id string, organization_id string, project_id string, project_version_id string, kind string, "
                   "original_name string, content_type string, storage_key string, size_bytes bigint, "
                   "checksum_sha256 string, created_at timestamp_ntz",
    "processing_jobs": "id string, organization_id string, project_id string, requested_by_user_id string, "
                       "source_file_asset_id string, project_version_id string, status string, quality string, "
                       "progress int, current_step string, logs string, error_message string, can_retry boolean, "
                       "created_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz",
    "lots": "id string, project_id string, project_version_id string, external_id string, name string, block string, "
            "area_m2 double, status string, color string, geometry_json string, properties_json string, "
            "sort_order int, created_at timestamp_ntz, updated_at timestamp_ntz",
    "share_links": "id string, project_id string, token string, token_hash string, password_hash string, "
                   "access_mode string, allow_edit boolean, active boolean, expires_at timestamp_ntz, "
                   "last_used_at timestamp_ntz, access_count int, created_at timestamp_ntz",
    "edit_proposals": "id string, project_id string, base_project_version_id string, proposed_by_user_id string, "
                      "share_link_id string, status string, title string, summary string, changes_json string, "
                      "review_notes string, created_at timestamp_ntz, decided_at timestamp_ntz",
    "sessions": "id string, user_id string, token_hash string, expires_at timestamp_ntz, "
                "created_at timestamp_ntz, last_seen_at timestamp_ntz",
    "integration_api_keys": "id string, organization_id string, project_id string, created_by_user_id string, "
                            "name string, token_hash string, scopes_json string, expires_at timestamp_ntz, "
                            "revoked_at timestamp_ntz, rate_window_start timestamp_ntz, rate_request_count int, "
                            "created_at timestamp_ntz",
    "integration_upload_requests": "id string, api_key_id string, project_id string, idempotency_key_hash string, "
                                   "request_hash string, job_id string, created_at timestamp_ntz",
    "integration_units": "id string, organization_id string, project_id string, external_system string, "
                         "external_unit_id string, block string, name string, status string, revision int, "
                         "mapping_state string, lot_id string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "integration_unit_lots": "lot_id string, unit_id string, project_version_id string",
    "integration_events": "id bigint, organization_id string, project_id string, event_type string, "
                          "payload_json string, created_at timestamp_ntz",
    "integration_availability_requests": "id string, project_id string, external_system string, event_id string, "
                                         "request_hash string, outcome_json string",
    "audit_events": "id string, actor_user_id string, organization_id string, action string, target_type string, "
                    "target_id string, details string, created_at timestamp_ntz",
    "integration_webhooks": "id string, organization_id string, project_id string, api_key_id string, "
                            "owner_user_id string, url string, event_types_json string, secret_nonce string, "
                            "active boolean, event_cursor bigint, created_at timestamp_ntz",
    "integration_webhook_deliveries": "id string, webhook_id string, event_id bigint, status string, attempts int, "
                                      "next_attempt_at timestamp_ntz, lease_until timestamp_ntz, "
                                      "lease_token string, last_http_status int, last_error string, "
                                      "created_at timestamp_ntz",
    "text_items": "sheet_id bigint, seq bigint, text string, x0 double, y0 double, x1 double, y1 double, "
                  "cx double, cy double",
    "drawing_items": "sheet_id bigint, seq bigint, layer string, kind string, coords array<double>",
    "segments": "sheet_id bigint, ax double, ay double, bx double, by double",
}

LOT_RECORD = (
    "struct<index:string,nome:string,name:string,lote:string,quadra:string,block:string,area:string,"
    "area_m2:string,pts:string,points:string,s:string,status_index:string,color:string,cor:string,"
    "`group`:string,extraido:boolean>"
)

JOB_LOGS = "array<struct<at:string,message:string>>"
