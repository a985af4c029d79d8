"""Adapter views that give the TPC-H-like test tables the shape of exported telemetry, for tests and checks only."""
