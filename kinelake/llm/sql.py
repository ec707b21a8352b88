"""SQL twins. P7 to P9 need a tokenizer or Unicode tables; they are held against brute force in tests."""

from __future__ import annotations

SQL: dict[str, str] = {
    "p6_found": """
        WITH r AS (
            SELECT robot_id, joint_name, ts_seconds * 1000000000 + ts_nanos AS r_at, reading_id FROM joint_readings
            WHERE ts_seconds IS NOT NULL AND ts_nanos IS NOT NULL AND joint_position IS NOT NULL AND NOT isnan(joint_position)
        ), h AS (
            SELECT hand_id, robot_id, joint_name, ts_seconds * 1000000000 + ts_nanos AS h_at FROM hand_states
            WHERE ts_seconds IS NOT NULL AND ts_nanos IS NOT NULL
        ), c AS (
            SELECT hand_id, reading_id, row_number() OVER (PARTITION BY hand_id ORDER BY abs(h_at - r_at), reading_id) AS k
            FROM h JOIN r ON h.robot_id = r.robot_id AND h.joint_name = r.joint_name AND r.r_at BETWEEN h.h_at - 40000000 AND h.h_at + 40000000
        )
        SELECT hand_id, reading_id FROM c WHERE k = 1
    """,
}
