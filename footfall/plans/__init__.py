"""Plan building blocks shared by the operators: durable intermediates, positions, top-n."""
