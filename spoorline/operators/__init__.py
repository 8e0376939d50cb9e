"""DataFrame to DataFrame operators; lazy, without collecting rows."""
