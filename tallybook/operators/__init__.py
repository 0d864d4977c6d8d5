"""Pipeline steps, joins, datasets and metrics as DataFrame transformations."""
