"""sediment.functions"""
