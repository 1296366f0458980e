"""DuckDB oracle SQL for the streams: the batch answer over all events."""

from __future__ import annotations

from profilebook.registry.sqlkit import with_tables

_LATEST = ("lt AS (SELECT * FROM wf_status_events QUALIFY row_number() OVER (PARTITION BY ID_CUSTOMER_FCC "
           "ORDER BY EVENT_TS DESC, EVENT_ID DESC) = 1)")
_STAGE = ("stage AS (SELECT DISTINCT a.ID_SOLICITUD FROM wf_application a JOIN wf_stage_history h ON h.NUMEROINCIDENTE = a.NU_INCIDENTE "
          "AND h.ID_PROCESO IN (1000, 2200) AND h.ID_STEP IN (1012, 2215) AND h.ESTADO_ETAPA = 1)")


def oracle() -> dict[str, str]:
    return {
        "stream_status": with_tables(["wf_status_events"], [_LATEST], profile=True) + (
            "SELECT p.ID_SOLICITUD, p.CUSTOMER_NO, p.ID_CUSTOMER_FCC, lt.ID_STATUS_FCC, lt.MSG_ERROR_FCC, "
            "lt.EVENT_TS AS FECHA_CREACION_CLIENTE, CAST(lt.EVENT_TS AS DATE) AS INCEPTION_DATE "
            "FROM profile p JOIN lt ON lt.ID_CUSTOMER_FCC = p.ID_CUSTOMER_FCC"),
        "stream_completeness": with_tables(["wf_status_events", "wf_application", "wf_stage_history"], [_LATEST, _STAGE], profile=True) + (
            "SELECT ID_SOLICITUD, count(*) AS EXPECTED, count(*) FILTER (WHERE status IN (1, 3)) AS CREATED, "
            "count(*) FILTER (WHERE status = 0) AS FAILED FROM (SELECT p.ID_SOLICITUD, CASE WHEN lt.EVENT_ID IS NULL THEN p.ID_STATUS_FCC "
            "ELSE lt.ID_STATUS_FCC END AS status FROM profile p LEFT JOIN lt ON lt.ID_CUSTOMER_FCC = p.ID_CUSTOMER_FCC "
            "WHERE p.CHK_CREATE_FCC = 1 AND p.LMT_CUSTOMER_TYPE <> 'G' AND EXISTS (SELECT 1 FROM stage s "
            "WHERE s.ID_SOLICITUD = p.ID_SOLICITUD)) GROUP BY 1"),
    }
