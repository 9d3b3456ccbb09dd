"""crawlsight: web-traffic robot analytics as Spark jobs."""
