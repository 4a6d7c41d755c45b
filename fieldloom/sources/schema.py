"""Schemas (DDL) of the tables that the pipeline reads and keeps."""

SCAN = (
    "scan_id long, robot_id string, ts timestamp, robot_pose struct<x:double,y:double,yaw:double>, "
    "angle_min double, angle_increment double, range_min double, range_max double, ranges array<double>"
)
POINT = "robot_id string, scan_id long, beam int, point_key long, x double, y double, angle double, range double"
SEGMENT = (
    "robot_id string, scan_id long, line_id long, room_id long, r double, theta double, nx double, ny double, dx double, dy double, x1 double, y1 double, x2 double, y2 double, "
    "weight int, robot_x double, robot_y double, is_short boolean, cluster_id int, n_points int"
)
EDGE = "src long, dst long, type string"
ROOM = "room_id long, cx double, cy double, min_x double, min_y double, max_x double, max_y double, lines array<long>"
GP_STATE = (
    "room_id long, version long, m int, zx array<double>, zy array<double>, mean array<double>, chol array<array<double>>, "
    "old_zx array<double>, old_zy array<double>, old_mean array<double>, old_c array<array<double>>, weights array<double>"
)
PREDICTION = "query_id long, room_id long, x double, y double, mu double, distance double, gx double, gy double"
METRIC = "model string, op string, scan_id long, num_points long, seconds double"


def names(ddl: str) -> list[str]:
    """Column names of a schema without nested fields."""
    return [c.split()[0] for c in ddl.split(", ")]
