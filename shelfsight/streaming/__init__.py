"""Continuous forms of the spend monitor and the job ticks."""
