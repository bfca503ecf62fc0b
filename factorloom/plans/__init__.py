"""Planning of expression batches."""
