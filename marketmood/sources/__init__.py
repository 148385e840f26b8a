"""Sources and sinks: schemas, readers/writers, fixture views, registries."""
