"""Training-data operators: each module holds one operator; ``registry`` binds them to the driver's queries."""
