"""Reports: scored rows in, long-form result tables out."""
