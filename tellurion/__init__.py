"""tellurion: telemetry and warehouse analytics as plain Spark plans."""
